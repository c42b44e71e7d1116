"""Phone registrations as a stream, with event times, repeats and late arrivals.

Two queries follow each other. The first answers every registration and parts the valid
ones into those on time and the late ones, which go to a table of their own. The second
drops repeats of a user within the watermark, with a state that forgets users behind it,
and inserts who is not in the user table yet; that table is kept in slots by user, and a
batch reads only the slots of its users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grievaline.plans.requests import validate_phone
from grievaline.sources.sinks import first_per_key, read_or_none, write_batch, write_batch_once
from grievaline.streaming.runs import run_stream

SLOTS = 256
DELAY = "1 day"
ACCEPTED = "user_id string, phone_number string, registered_at timestamp"


def slot_of(key: str):
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def newest_before(spark: SparkSession, target: str, batch_id: int):
    """The newest time of all batches before this one; each mark holds that of its own too."""
    last = read_or_none(spark, f"{target}/marks/batch={batch_id - 1}")
    if last is None:
        marks = read_or_none(spark, f"{target}/marks")
        last = marks.where(F.col("batch") < batch_id) if marks is not None else None
    return None if last is None else last.agg(F.max("newest")).first()[0]


def answer_stream(
    users: DataFrame, target: str, checkpoint: str, delay: str = DELAY, every: str | None = None
) -> StreamingQuery:
    """Answers all rows (``target/answers``) and parts the valid ones by lateness.

    Input is ``user_id, phone, registered_at``. ``target/on_time`` and ``target/late`` hold
    the accepted rows, ``target/marks`` the newest time of each batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(validate_phone(batch, "registered_at"), f"{target}/answers", batch_id)
        checked = spark.read.parquet(f"{target}/answers/batch={batch_id}")
        before = newest_before(spark, target, batch_id)
        known = F.lit(before).cast("timestamp")
        newest = checked.agg(F.greatest(F.max("registered_at"), known).alias("newest"))
        write_batch(newest.coalesce(1), f"{target}/marks", batch_id)
        mark = known - F.expr(f"INTERVAL {delay}")
        late = F.col("registered_at").isNull()
        if before is not None:
            late = late | (F.col("registered_at") < mark)
        rows = checked.where("accepted").select("user_id", "phone_number", "registered_at")
        write_batch(rows.where(late), f"{target}/late", batch_id)
        write_batch_once(rows.where(~late), f"{target}/on_time", batch_id)

    return run_stream(users, each, checkpoint, every=every)


def insert_missing(rows: DataFrame, target: str, batch: str) -> None:
    """Inserts the users of ``rows`` that the table lacks, once each, as a folder ``batch``.

    Only the slots of these users are read, at most ``SLOTS`` numbers are collected. A
    repeated call with one ``batch`` leaves out what it wrote before and writes it again.
    """
    spark = rows.sparkSession
    one = first_per_key(rows.select("user_id", "phone_number", "registered_at"), "user_id").withColumn("slot", slot_of("user_id"))
    held = read_or_none(spark, f"{target}/users")
    if held is not None:
        slots = [r["slot"] for r in one.select("slot").distinct().collect()]
        earlier = held.where(F.col("slot").isin(slots) & (F.col("batch") != batch))
        one = one.join(earlier.select("user_id"), "user_id", "left_anti")
    one = one.select("user_id", "phone_number", "registered_at", F.current_timestamp().alias("created_at"), "slot", F.lit(batch).alias("batch"))
    # a replay of the batch replaces its own folders
    one.repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(f"{target}/users")


def insert_stream(
    spark: SparkSession, target: str, checkpoint: str, delay: str = DELAY, every: str | None = None
) -> StreamingQuery:
    """Inserts the users that arrived on time; repeats within the delay meet the state only."""
    on_time = (
        spark.readStream.schema(ACCEPTED + ", batch long").parquet(f"{target}/on_time")
        .select("user_id", "phone_number", "registered_at")
        .withWatermark("registered_at", delay)
        .dropDuplicatesWithinWatermark(["user_id"])
    )
    return run_stream(
        on_time, lambda batch, batch_id: insert_missing(batch, target, f"b{batch_id}"), checkpoint, every=every
    )


def insert_late(spark: SparkSession, target: str, name: str) -> None:
    """Inserts the users who only registered late, in a batch of their own, ``name``."""
    late = read_or_none(spark, f"{target}/late")
    if late is not None:
        insert_missing(late, target, name)


def registration_stream(
    users: DataFrame, target: str, checkpoint: str, every: str | None = None, delay: str = DELAY
) -> StreamingQuery:
    """Both queries over everything that has arrived; with ``every`` both keep running.

    Rows without a ``registered_at`` column get the time of their arrival. Returns the
    inserting query, whose progress tells the size of the state.
    """
    if "registered_at" not in users.columns:
        users = users.withColumn("registered_at", F.current_timestamp())
    spark = users.sparkSession
    if read_or_none(spark, f"{target}/on_time") is None:  # the second query follows a folder
        write_batch_once(spark.createDataFrame([], ACCEPTED), f"{target}/on_time", -1)
    answer_stream(users, target, f"{checkpoint}/answers", delay, every)
    return insert_stream(spark, target, f"{checkpoint}/inserts", delay, every)
