"""What is registered: queries and the SQL they are compared with."""

from __future__ import annotations

import importlib

from grievaline.oracle.build import QUERIES, statement
from grievaline.registry import REGISTERED, Query

for _module in ("queries_requests", "queries_rules", "queries_chat", "queries_search", "queries_streams"):
    importlib.import_module(f"grievaline.{_module}")
for _module in ("requests", "rules", "chat", "search", "streams"):
    importlib.import_module(f"grievaline.oracle.{_module}")


def queries() -> dict[str, Query]:
    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    return {name: statement(sql) for name, sql in QUERIES.items()}
