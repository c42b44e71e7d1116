"""All registered queries: name to ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def registered(fn: Query) -> Query:
    REGISTERED[fn.__name__] = fn
    return fn
