"""Keyed lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unused(taken: list[str], *names: str) -> list[str]:
    """``names``, made longer where a column of ``taken`` bears one of them in any case."""
    lower = {c.lower() for c in taken}
    found = []
    for name in names:
        while name in lower:
            name += "_"
        found.append(name)
    return found


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    spread_by: str,
    share: int = 1000,
    floor: int = 100_000,
    salts: int = 64,
) -> DataFrame:
    """``rows`` left-joined to ``table``, which has one row per ``key``.

    A key is hot if it holds more than ``1/share`` of the rows (and more than
    ``floor`` rows); there can be fewer than ``share`` such keys, which bounds the
    broadcast. The rows of a hot key are spread over ``salts`` sub-keys and only
    its single table row is copied to each of them.
    """
    hot_, salt_, n_ = unused([*rows.columns, *table.columns], "_hot", "_salt", "_n")
    counts = rows.groupBy(key).agg(F.count("*").alias(n_))
    total = counts.select(F.sum(n_)).scalar()
    hot = counts.where(
        F.col(key).isNotNull() & (F.col(n_) > floor) & (F.col(n_) * share > total)
    ).select(key, F.lit(True).alias(hot_))
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn(
        salt_, F.when(F.col(hot_), salt).otherwise(F.lit(0))
    )
    # A null key matches nothing, so its rows may go anywhere.
    left = left.withColumn(salt_, F.when(F.col(key).isNull(), salt).otherwise(F.col(salt_)))
    right = table.join(F.broadcast(hot), key, "left").withColumn(
        salt_, F.explode(F.when(F.col(hot_), every).otherwise(F.array(F.lit(0))))
    )
    return left.drop(hot_).join(right.drop(hot_), [key, salt_], "left").drop(salt_)
