"""Row-level differences between two versions of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_feed(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``keys`` and ``change_type`` (insert, update, delete) of every differing row.

    Only keys and a digest of the values are shuffled. A null value and an empty
    one give different digests.
    """

    def digest(version: DataFrame, name: str) -> DataFrame:
        row = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
        return version.select(*keys, F.sha2(row, 256).alias(name))

    both = digest(old, "_old").join(digest(new, "_new"), keys, "full_outer")
    kind = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(F.col("_old") != F.col("_new"), "update")
    )
    return both.withColumn("change_type", kind).where("change_type IS NOT NULL").drop("_old", "_new")
