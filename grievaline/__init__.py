"""Passenger-grievance data jobs on Spark.

``sources``   tables, input shapes, file readers, sinks and the shared work folder
``functions`` column expressions (text, payloads, labels, scripts)
``operators`` distributed building blocks (numbering, hot-key joins, nearest, changes)
``plans``     the jobs: DataFrame in, DataFrame out
``streaming`` the same jobs over streams
``oracle``    the SQL each registered query is compared with
"""
