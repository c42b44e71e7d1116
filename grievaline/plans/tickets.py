"""Ticket uploads: payload checks, readings, booking rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grievaline.functions import payloads
from grievaline.functions.text import filled

TICKET_FOLDER = "/shared/ticket_uploads/"
JOURNEY_COLUMNS = [
    "journey_id",
    "user_id",
    *payloads.TICKET_KEYS,
    "ticket_image_path",
    "extracted_data",
    "created_at",
]


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole image files with name and media type; empty files are left out."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.where("length > 0").select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "length",
        payloads.image_type(F.col("content")).alias("image_type"),
        F.sha1("content").alias("content_sha1"),
        "content",
    )


def decode_payloads(images: DataFrame) -> DataFrame:
    """Bytes of each payload, or the reason why there are none."""
    bare = payloads.bare_base64(F.coalesce(F.col("payload"), F.lit("")))
    rows = images.withColumn("_bare", bare).withColumn("bytes", payloads.decoded(F.col("_bare")))
    message = F.when(F.col("_bare") == "", "No image bytes received.").when(
        F.col("bytes").isNull(), "Failed to process ticket: invalid base64 image"
    )
    return rows.withColumn("message", F.coalesce(message, F.lit(""))).drop("_bare")


def parse_readings(replies: DataFrame) -> DataFrame:
    """The ten reading columns and the state of every model reply."""
    rows = (
        replies.withColumn("blob", payloads.json_blob(F.col("reply")))
        .withColumn("reading", payloads.one_object(F.col("blob"), payloads.TICKET_TYPE))
        .withColumn(
            "state", payloads.reading_state(F.col("reply"), F.col("reading").isNotNull())
        )
    )
    return rows.select(
        *replies.columns,
        "state",
        F.when(F.col("state") == "parsed", F.col("blob")).otherwise("{}").alias("extracted"),
        *[F.col("reading").getField(k).alias(k) for k in payloads.TICKET_KEYS],
    )


def image_path(folder: str, key: Column) -> Column:
    return F.concat(F.rtrim(F.lit(folder), F.lit("/")), F.lit("/"), key, F.lit(".jpg"))


def replay_id(*parts: str) -> Column:
    """An id that a rerun of the same input gives again."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def journey_rows(
    readings: DataFrame, key: Column, at: Column, folder: str = TICKET_FOLDER
) -> DataFrame:
    """Booking rows of all readings that did not fail, in table column order."""
    return (
        readings.where("state <> 'not_object'")
        .withColumn("user_id", filled(F.col("user_id"), "unknown"))
        .withColumn("journey_id", key)
        .withColumn("ticket_image_path", image_path(folder, F.col("journey_id")))
        .withColumn("extracted_data", F.col("reply"))
        .withColumn("created_at", at)
        .select(*JOURNEY_COLUMNS)
    )


def ticket_outcome(readings: DataFrame, key: Column) -> DataFrame:
    """Status, message, id and reading of every ticket; broken text is still a success.

    The id is that of the booking row: the key is taken behind the user's default.
    """
    failed = F.col("state") == "not_object"
    return readings.withColumn("user_id", filled(F.col("user_id"), "unknown")).select(
        "event_id",
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(failed, "Failed to process ticket: reply is not an object")
        .otherwise("Ticket processed and journey details saved")
        .alias("message"),
        F.when(failed, "").otherwise(key).alias("journey_id"),
        F.when(failed, "").otherwise(F.col("extracted")).alias("extracted_data"),
    )


def parse_rates(readings: DataFrame, images: DataFrame) -> DataFrame:
    """Replies per image type and state; a reply belongs to the image with its id."""
    typed = images.select(
        F.col("image_id").alias("event_id"), payloads.image_type(F.col("content")).alias("image_type")
    )
    states = {s: F.count_if(F.col("state") == s) for s in ("parsed", "empty", "broken", "not_object")}
    return (
        readings.select("event_id", "state")
        .join(typed, "event_id", "left")
        .groupBy(F.coalesce("image_type", F.lit("no image")).alias("image_type"))
        .agg(*[c.alias(f"n_{s}") for s, c in states.items()])
    )
