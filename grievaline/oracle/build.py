"""Comparison SQL: named views and a query, put together as one statement."""

from __future__ import annotations

import re

from grievaline.functions.text import BLANK_CLASS, BLANKS, LINE_END
from grievaline.sources.shapes import NAMED

VIEWS: dict[str, str] = {name: shape.sql() for name, shape in NAMED.items()}
QUERIES: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def query(name: str, sql: str) -> None:
    QUERIES[name] = sql


def strip(c: str) -> str:
    return f"trim({c}, '{BLANKS}')"


def labelled(table: dict[str, str], key: str, unknown: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {unknown} END"


def statement(sql: str) -> str:
    """``sql`` behind a WITH list of the views it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[fv]_\w+", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    listed = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {listed}\n{sql}"


__all__ = ["BLANK_CLASS", "LINE_END", "QUERIES", "VIEWS", "labelled", "query", "statement", "strip", "view"]
