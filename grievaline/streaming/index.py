"""The vector table, kept in step with the rulebook texts.

The table lies in slots by text, a folder each. It holds one row per chunk with the digest
of its text, its vector, the batch that wrote it and a mark if the chunk is gone. A sync
compares ids and digests, and rewrites only the slots in which something changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grievaline.functions.text import hashed_counts
from grievaline.plans.retrieval import DIMS, passages
from grievaline.sources.sinks import read_or_none
from grievaline.sources.tables import spread
from grievaline.sources.workdir import pinned
from grievaline.streaming.runs import run_stream

SLOTS = 256
ROW = ["id", "doc_id", "digest", "vec", "gone", "batch", "slot"]


def slot() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")


def live_index(spark: SparkSession, path: str) -> DataFrame | None:
    """``id, doc_id, digest, vec, batch`` of all chunks that are not gone."""
    table = read_or_none(spark, path)
    return None if table is None else table.where(~F.col("gone")).drop("gone", "slot")


def slots_of(rows: DataFrame) -> list[int]:
    """The slots of some texts, at most ``SLOTS`` numbers."""
    return [r["slot"] for r in rows.select(slot().alias("slot")).distinct().collect()]


def write_slots(rows: DataFrame, path: str) -> None:
    """Replaces the folders of the slots that ``rows`` has."""
    writer = rows.select(*ROW).repartition("slot").sortWithinPartitions("slot", "id").write
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)


def found_changes(documents: DataFrame, path: str, whole: bool) -> DataFrame:
    """``id, doc_id, digest`` of the chunks that differ; no digest where a chunk is gone.

    With ``whole`` ids and digests of all slots are read, else those of the documents'.
    """
    now = passages(documents).select("id", "doc_id", F.sha2("text", 256).alias("digest"))
    known = documents.sparkSession.read.parquet(path)
    if not whole:
        arrived = documents.select("doc_id").distinct()
        known = known.where(F.col("slot").isin(slots_of(arrived))).join(arrived, "doc_id", "left_semi")
    known = known.where(~F.col("gone")).select(
        "id", F.col("doc_id").alias("held_doc"), F.col("digest").alias("held")
    )
    # Ids and digests meet; text is only read again where something changed.
    return (
        now.join(known, "id", "full_outer")
        .where(~F.col("digest").eqNullSafe(F.col("held")))
        .select("id", F.coalesce("doc_id", "held_doc").alias("doc_id"), "digest")
    )


def sync_index(documents: DataFrame, path: str, batch_id: int, whole: bool) -> None:
    """Brings the index at ``path`` to ``documents``; only changed chunks are embedded.

    With ``whole`` the documents are all there are and missing ones are withdrawn;
    otherwise only the chunks of the given documents are compared. Only slots with a
    change are read in full and written; their marks of chunks that earlier batches
    withdrew go. The new slots are made aside before they replace the old ones, and a
    repeated call finds what it wrote and writes nothing, so a call may fail anywhere.
    """
    spark = documents.sparkSession
    documents = spread(documents.select("doc_id", "text"), "doc_id")
    if read_or_none(spark, path) is None:
        write_slots(embedded(passages(documents), batch_id), path)
        return
    changes = pinned(found_changes(documents, path, whole))
    touched = slots_of(changes)
    if not touched:
        return
    present = changes.where("digest IS NOT NULL")
    fresh = embedded(
        passages(documents.join(present.select("doc_id").distinct(), "doc_id", "left_semi")).join(
            present.select("id"), "id", "left_semi"
        ),
        batch_id,
    )
    gone = changes.where("digest IS NULL").select(
        "id",
        "doc_id",
        "digest",
        F.lit(None).cast("array<int>").alias("vec"),
        F.lit(True).alias("gone"),
        F.lit(batch_id).cast("bigint").alias("batch"),
        slot().alias("slot"),
    )
    kept = touched_slots(spark, path, touched).where(~F.col("gone")).join(changes.select("id"), "id", "left_anti")
    write_slots(pinned(kept.select(*ROW).unionByName(fresh).unionByName(gone)), path)


def touched_slots(spark: SparkSession, path: str, slots: list[int]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("slot").isin(slots))


def embedded(chunks: DataFrame, batch_id: int) -> DataFrame:
    return chunks.select(
        "id",
        "doc_id",
        F.sha2("text", 256).alias("digest"),
        hashed_counts(F.col("text"), DIMS).alias("vec"),
        F.lit(False).alias("gone"),
        F.lit(batch_id).cast("bigint").alias("batch"),
        slot().alias("slot"),
    )


def index_stream(
    documents: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Indexes documents as they arrive; an arriving document replaces its chunks."""
    return run_stream(
        documents,
        lambda batch, batch_id: sync_index(batch, path, batch_id, whole=False),
        checkpoint,
        every=every,
    )
