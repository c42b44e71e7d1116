"""Cleaning, routing and rejecting request rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grievaline.functions.text import filled, present, strip

REQUEST_COLUMNS = [
    "request_type",
    "query",
    "train_number",
    "pnr",
    "issue_type",
    "language_code",
    "ticket_image_base64",
    "user_id",
]


def read_requests(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Request rows from JSON lines; one object is one row, absent keys are null."""
    names = [*(ids or []), *REQUEST_COLUMNS]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.read.schema(schema).json(path)


def clean_request(rows: DataFrame) -> DataFrame:
    """Blank strings and NaN become null in every column; other values stay as they are."""

    def cleaned(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            return present(c).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c).alias(field.name)
        return c

    return rows.select(*[cleaned(f) for f in rows.schema.fields])


def route_of_cleaned() -> Column:
    """``chat``, ``ticket`` or ``complaint``; the order of the tests matters."""
    kind = F.lower(strip(F.col("request_type")))
    plain_message = (
        F.col("query").isNotNull()
        & F.col("user_id").isNotNull()
        & F.col("issue_type").isNull()
        & F.col("pnr").isNull()
        & F.col("train_number").isNull()
    )
    return (
        F.when(kind == "chat", "chat")
        .when((kind == "ticket") | F.col("ticket_image_base64").isNotNull(), "ticket")
        .when(kind == "complaint", "complaint")
        .when(plain_message, "chat")
        .otherwise("complaint")
    )


def route_requests(rows: DataFrame) -> DataFrame:
    return clean_request(rows).withColumn("route", route_of_cleaned())


def reject_empty_query(routed: DataFrame) -> DataFrame:
    """The query stripped, and the fixed error of a row that needs one and has none."""
    missing = F.col("query").isNull() & (F.col("route") != "ticket")
    return routed.select(
        "request_id",
        "route",
        strip(F.col("query")).alias("query"),
        F.when(missing, "error").otherwise("ok").alias("status"),
        F.when(missing, "empty query").otherwise("").alias("message"),
        F.when(missing & (F.col("route") == "complaint"), "ERROR: empty query")
        .otherwise("")
        .alias("engine_notes"),
    )


def fill_defaults(rows: DataFrame) -> DataFrame:
    """The defaults each later step sees for absent optional fields."""
    return rows.withColumns(
        {
            "issue_type": filled(F.col("issue_type"), "other"),
            "user_id": filled(F.col("user_id"), "unknown"),
            "train_number": filled(F.col("train_number"), ""),
            "pnr": filled(F.col("pnr"), ""),
            "language_code": F.nullif(F.col("language_code"), F.lit("")),
        }
    )


def split_required(images: DataFrame) -> DataFrame:
    """Uploads need a user and bytes; the reason tells which is missing."""
    reason = F.when(F.coalesce(F.col("user_id"), F.lit("")) == "", "user_id is required.").when(
        F.coalesce(F.col("n_bytes"), F.lit(0)) == 0, "Empty file."
    )
    return images.withColumn("accepted", reason.isNull()).withColumn(
        "reason", F.coalesce(reason, F.lit(""))
    )


def validate_phone(users: DataFrame, *more: str) -> DataFrame:
    """Outer blanks off, then exactly ten decimal digits of any script; ``more`` columns stay."""
    phone = strip(F.coalesce(F.col("phone"), F.lit("")))
    valid = phone.rlike(r"\A\p{Nd}{10}\z")
    return users.select(
        "user_id",
        phone.alias("phone_number"),
        valid.alias("accepted"),
        F.when(valid, "").otherwise("Phone number must be exactly 10 digits.").alias("reason"),
        *more,
    )


def route_counts(unified: DataFrame) -> DataFrame:
    return unified.groupBy("request_type", "status").agg(F.count("*").alias("n"))
