"""Registered queries that run a stream to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from grievaline.queries_chat import shown
from grievaline.queries_requests import given, inputs, tool_logs
from grievaline.registry import registered
from grievaline.sources.shapes import shaped
from grievaline.sources.tables import stream_table
from grievaline.sources.workdir import new_dir
from grievaline.streaming import bookings, index, registrations, scoring


def arriving(spark, sf_dir, name):
    return shaped(name, lambda table: stream_table(spark, sf_dir, table))


@registered
def registration_stream(spark, sf_dir):
    target = new_dir(spark, "registrations")
    registrations.registration_stream(
        arriving(spark, sf_dir, "f_registrations"), target, f"{target}/checkpoint"
    )
    return spark.read.parquet(f"{target}/users").select("user_id", "phone_number")


@registered
def request_stream(spark, sf_dir):
    target = new_dir(spark, "scored")
    _, replies, translations = inputs(spark, sf_dir)
    scoring.request_stream(
        arriving(spark, sf_dir, "f_requests"),
        replies,
        translations,
        tool_logs(spark, sf_dir),
        f"{target}/rows",
        f"{target}/checkpoint",
    )
    return spark.read.parquet(f"{target}/rows").drop("batch")


@registered
def triggered_index_sync(spark, sf_dir):
    """First all texts of the old version as a stream, then a sync to the new one."""
    target = new_dir(spark, "index")
    old = arriving(spark, sf_dir, "f_old_documents").select("doc_id", "text")
    index.index_stream(old, f"{target}/log", f"{target}/checkpoint")
    new = given(spark, sf_dir, "f_new_documents").select("doc_id", "text")
    index.sync_index(new, f"{target}/log", 1 << 20, whole=True)
    live = index.live_index(spark, f"{target}/log")
    return live.select(
        "id",
        "doc_id",
        "digest",
        F.array_join(F.col("vec").cast("array<string>"), ",").alias("vec"),
        (F.col("batch") == 1 << 20).alias("embedded_by_sync"),
    )


@registered
def latest_journey_stream(spark, sf_dir):
    target = new_dir(spark, "latest")
    bookings.latest_journey_stream(
        arriving(spark, sf_dir, "f_journey"), f"{target}/updates", f"{target}/checkpoint"
    )
    return shown(bookings.current_journeys(spark.read.parquet(f"{target}/updates")))


@registered
def latest_journey_changes(spark, sf_dir):
    """The last change of every user's newest booking, from keyed state."""
    target = new_dir(spark, "changes")
    bookings.booking_changes(
        arriving(spark, sf_dir, "f_journey"), f"{target}/updates", f"{target}/checkpoint"
    )
    return shown(bookings.current_journeys(spark.read.parquet(f"{target}/updates")))
