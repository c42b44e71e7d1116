"""The newest booking of every user, kept up to date."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from grievaline.plans.bookings import latest_by_aggregate
from grievaline.sources.sinks import write_batch
from grievaline.streaming.runs import run_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


class NewestBooking(StatefulProcessor):
    """Keeps a user's newest booking as a value state and tells when it changes.

    Bookings come as ``created_at`` in microseconds, ``journey_id`` and further columns; rows
    come and go as they are, no frame is made for each of the users. With ``keep_ms`` a
    timer clears the state that long after the booking's time, by the watermark. Bookings
    older than the watermark do not arrive any more, so what comes later is newer than
    the cleared one.
    """

    def __init__(self, names: list[str], kinds: str, keep_ms: int | None):
        self.names, self.kinds, self.keep_ms = names, kinds, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.kinds)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.newest.get()
        place = None if held is None else tuple(held[:2])
        best, at = None, None
        for row in rows:
            if at is None:
                at = [row.__fields__.index(n) for n in self.names]
            found = (row[at[0]], row[at[1]])
            if place is None or found > place:
                best, place = row, found
        if best is None:
            return
        best = tuple(best[i] for i in at)
        self.newest.update(best)
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(best[0] // 1000 + self.keep_ms)
        yield Row("user_id", *self.names)(*key, *best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def booking_changes(
    journeys: DataFrame,
    target: str,
    checkpoint: str,
    every: str | None = None,
    delay: str | None = None,
    keep_ms: int | None = None,
) -> StreamingQuery:
    """Writes a row when a user's newest booking changes, and nothing else.

    The state is one value per user in the RocksDB store. With ``delay`` and ``keep_ms``
    bookings later than ``delay`` are left out and users without a booking for
    ``keep_ms`` (at least the delay) leave the state.
    """
    spark = journeys.sparkSession
    first = ["created_at", "journey_id"]
    given = [*first, *[c for c in journeys.columns if c not in (*first, "user_id")]]
    # A column may be named like a word of Python, such as ``class``.
    names = [f"v{i}" for i in range(len(given))]
    rows = journeys.where("user_id IS NOT NULL AND created_at IS NOT NULL").select(
        "user_id",
        F.col("created_at").cast("timestamp").alias("arrived"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("v0"),
        *[F.col(c).alias(n) for n, c in list(zip(names, given))[1:]],
    )
    rows = rows.withWatermark("arrived", delay) if delay is not None else rows.drop("arrived")
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    changes = rows.groupBy("user_id").transformWithState(
        NewestBooking(names, kinds, keep_ms),
        f"user_id {rows.schema['user_id'].dataType.simpleString()}, {kinds}",
        "Append",
        "EventTime" if keep_ms is not None else "None",
    )
    told = changes.withColumn("v0", F.timestamp_micros("v0"))
    told = told.select("user_id", *[F.col(n).alias(c) for n, c in zip(names, given)])
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        return run_stream(
            told, lambda batch, batch_id: write_batch(batch, target, batch_id), checkpoint, every=every
        )
    finally:
        spark.conf.set(STORE, before)


def latest_journey_stream(
    journeys: DataFrame, target: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Writes the users whose newest booking a batch may have changed.

    The state holds one row per user; partial aggregation runs before its shuffle.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, target, batch_id)

    newest = latest_by_aggregate(journeys)
    return run_stream(newest, each, checkpoint, mode="update", every=every)


def current_journeys(updates: DataFrame) -> DataFrame:
    """The last written state of every user."""
    columns = [c for c in updates.columns if c not in ("user_id", "batch")]
    last = F.max_by(F.struct(*columns), F.col("batch"))
    return updates.groupBy("user_id").agg(last.alias("j")).select("user_id", "j.*")
