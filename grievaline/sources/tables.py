"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(
    spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000
) -> DataFrame:
    """The same table as a file stream; the schema comes from the parquet footer.

    The stream reader takes a plain path for a folder only; as a pattern the name
    fits a table in one file too.
    """
    schema = read_table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{sf_dir}/{name}.parque[t]")
    )


def spread(frame: DataFrame, key: str) -> DataFrame:
    """``frame`` shared out by ``key`` if its scan has fewer tasks than there are cores.

    For costly work per row on a table in a few large files; a scan with enough
    tasks stays as it is and is not shuffled.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.isStreaming or frame.rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores, key)
