"""Registered queries on rulebook texts and tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from grievaline.functions import payloads
from grievaline.functions.text import flat_page
from grievaline.operators.changes import change_feed as changed_rows
from grievaline.plans import requests, rules, tickets
from grievaline.queries_requests import given
from grievaline.registry import registered
from grievaline.sources.sinks import append_missing
from grievaline.sources.tables import spread
from grievaline.sources.workdir import new_dir

BATCH_TIME = "2024-02-01 00:00:00"


def documents(spark, sf_dir, version="f_documents"):
    return spread(given(spark, sf_dir, version), "doc_id")


@registered
def page_text_source(spark, sf_dir):
    return rules.pages(documents(spark, sf_dir))


@registered
def flatten_page_text(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select("doc_id", flat_page(F.col("text")).alias("text")).where("text <> ''")


@registered
def sliding_chunks(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return rules.sliding_chunks(rows).select("doc_id", "start", "text")


@registered
def chunk_no_in_source(spark, sf_dir):
    rows = rules.chunk_table(documents(spark, sf_dir), global_numbers=False)
    return rows.select("source", "page", "start", "chunk_no_in_source")


@registered
def chunk_no_global(spark, sf_dir):
    rows = rules.chunk_table(documents(spark, sf_dir))
    return rows.select("source", "page", "start", "chunk_id")


@registered
def chunk_surrogate_id(spark, sf_dir):
    rows = rules.sliding_chunks(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "start", rules.chunk_id().alias("id"))


@registered
def chunk_stats(spark, sf_dir):
    return rules.chunk_stats(documents(spark, sf_dir))


@registered
def chunk_table_overwrite(spark, sf_dir):
    rows = rules.chunk_table(documents(spark, sf_dir), global_numbers=False)
    table = rules.overwrite_table(rows, "grievaline_rules", "rule_chunks")
    return table.groupBy("source").agg(F.count("*").alias("n_chunks"))


@registered
def schema_merge_write(spark, sf_dir):
    current, target = (new_dir(spark, f"merge_{n}") for n in ("current", "target"))
    old = given(spark, sf_dir, "f_old_documents").withColumn("n_chars", F.length("text"))
    old.select("doc_id", "source", "n_chars").write.parquet(current)
    new = given(spark, sf_dir, "f_new_documents").select(
        "doc_id", "source", "lang", F.md5("text").alias("text_md5")
    )
    return rules.overwrite_merged(spark, current, new, target)


@registered
def change_feed(spark, sf_dir):
    old, new = (
        rules.sliding_chunks(documents(spark, sf_dir, f"f_{v}_documents").select("doc_id", "text"))
        for v in ("old", "new")
    )
    return changed_rows(old, new, ["doc_id", "start"], ["text"])


def decoded_images(spark, sf_dir):
    return tickets.decode_payloads(given(spark, sf_dir, "f_images"))


def readings(spark, sf_dir):
    replies = spread(given(spark, sf_dir, "f_ticket_replies"), "event_id")
    return tickets.parse_readings(replies)


@registered
def image_file_source(spark, sf_dir):
    """Files of bounded size written from the image table, read back whole."""
    folder = new_dir(spark, "images")
    text = F.when(F.col("p_partkey") % 3 == 0, "GIF89a").when(
        F.col("p_partkey") % 3 == 1, "RIFF....WEBP"
    )
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_brand", F.concat(F.coalesce(text, F.lit("BM")), "p_name").alias("value")
    )
    rows.write.option("maxRecordsPerFile", 10_000).partitionBy("p_brand").text(folder)
    images = tickets.read_images(spark, folder, "*.txt")
    return images.select("name", "length", "image_type", "content_sha1")


@registered
def base64_payloads(spark, sf_dir):
    return decoded_images(spark, sf_dir).select(
        "image_id", "message", F.octet_length("bytes").alias("n_bytes"), F.hex("bytes").alias("head")
    )


@registered
def image_type_sniff(spark, sf_dir):
    rows = given(spark, sf_dir, "f_images")
    return rows.select("image_id", payloads.image_type(F.col("content")).alias("image_type"))


@registered
def required_field_split(spark, sf_dir):
    sizes = decoded_images(spark, sf_dir).select(
        F.col("image_id").alias("event_id"), F.octet_length("bytes").alias("n_bytes")
    )
    uploads = given(spark, sf_dir, "f_ticket_replies").select("event_id", "user_id")
    rows = requests.split_required(uploads.join(sizes, "event_id", "left"))
    return rows.select("event_id", "accepted", "reason")


@registered
def json_blob_extract(spark, sf_dir):
    rows = given(spark, sf_dir, "f_ticket_replies")
    return rows.select("event_id", payloads.json_blob(F.col("reply")).alias("blob"))


@registered
def ticket_json_parse(spark, sf_dir):
    return readings(spark, sf_dir).select("event_id", "state", *payloads.TICKET_KEYS)


def journeys(spark, sf_dir):
    return tickets.journey_rows(
        readings(spark, sf_dir),
        tickets.replay_id("user_id", "event_id", "reply"),
        F.lit(BATCH_TIME).cast("timestamp"),
    )


@registered
def journey_projection(spark, sf_dir):
    return journeys(spark, sf_dir).drop("created_at")


@registered
def ticket_image_path(spark, sf_dir):
    key = F.col("event_id").cast("string")
    rows = given(spark, sf_dir, "f_ticket_replies")
    return rows.select("event_id", tickets.image_path(tickets.TICKET_FOLDER, key).alias("path"))


@registered
def journey_ids(spark, sf_dir):
    """Random ids and the current time, for rows without a replay rule."""
    rows = tickets.journey_rows(readings(spark, sf_dir), F.uuid(), F.current_timestamp())
    return rows.select("user_id", "journey_id", "created_at")


@registered
def ticket_outcome(spark, sf_dir):
    return tickets.ticket_outcome(
        readings(spark, sf_dir), tickets.replay_id("user_id", "event_id", "reply")
    )


@registered
def ticket_parse_rates(spark, sf_dir):
    return tickets.parse_rates(readings(spark, sf_dir), given(spark, sf_dir, "f_images"))


@registered
def journey_append(spark, sf_dir):
    path = new_dir(spark, "journey")
    append_missing(journeys(spark, sf_dir), path, "journey_id")
    return spark.read.parquet(path).select(*tickets.JOURNEY_COLUMNS[:-1])


@registered
def user_append(spark, sf_dir):
    """Accepted users appended, with the whole call repeated once."""
    path = new_dir(spark, "users")
    users = requests.validate_phone(given(spark, sf_dir, "f_users")).where("accepted")
    rows = users.select("user_id", "phone_number", F.lit(BATCH_TIME).cast("timestamp").alias("created_at"))
    for _ in range(2):
        append_missing(rows, path, "user_id")
    return spark.read.parquet(path).select("user_id", "phone_number")
