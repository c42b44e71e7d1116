"""Training-data operators: deduplication, archives, tokens, language, shards, mixing.

Each module is one operator with a general interface. ``queries`` applies each one to
its whole table as a registered query, ``oracle`` holds the SQL where SQL can say it.
Nothing outside this folder imports it.
"""
