"""Append sinks that a repeated run cannot duplicate."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def first_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row per ``key``: the earliest ``created_at`` if there is one, then the
    smallest of the other columns in their order, so that a replay keeps the same row."""
    others = [c for c in rows.columns if c != key]
    ordered = sorted(others, key=lambda c: c != "created_at")
    first = rows.groupBy(key).agg(F.min(F.struct(*ordered)).alias("_first"))
    return first.select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def append_missing(rows: DataFrame, path: str, key: str) -> None:
    """Appends one row per ``key`` that the table at ``path`` does not hold yet.

    Repeats inside a call are reduced by a fixed rule, a retried task is undone by the
    file commit, a repeated call by the anti-join.
    """
    held = read_or_none(rows.sparkSession, path)
    rows = first_per_key(rows, key)
    if held is not None:
        rows = rows.join(held.select(key), key, "left_anti").select(*held.columns)
    rows.write.mode("append").parquet(path)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One stream batch in a folder of its own; a replayed batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_batch_once(rows: DataFrame, path: str, batch_id: int) -> None:
    """The same, but a complete folder stays: a stream that follows may have listed its files."""
    spark = rows.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        write_batch(rows, path, batch_id)
