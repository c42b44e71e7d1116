"""Latest bookings and what requests take from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grievaline.functions.labels import lookup
from grievaline.functions.payloads import TICKET_KEYS
from grievaline.functions.text import present
from grievaline.operators.asof import as_of_join
from grievaline.operators.hotkeys import lookup_join

POINT_READ = f"""
    SELECT {", ".join(f"`{k}`" for k in TICKET_KEYS)}
    FROM {{journeys}} WHERE user_id = :user_id
    ORDER BY created_at DESC, journey_id DESC LIMIT 1
"""


def read_latest(spark: SparkSession, journeys: DataFrame, user_id: str) -> DataFrame:
    """The newest booking of one user, the value bound as a parameter."""
    return spark.sql(POINT_READ, args={"user_id": user_id}, journeys=journeys)


def store_by_user(journeys: DataFrame, path: str, row_group_bytes: int = 1 << 20) -> DataFrame:
    """The bookings laid out for point reads: sorted by user over files and row groups.

    Ranges of users go to files, so that statistics and the page index leave few row
    groups for a user; the Bloom filter spares those whose range merely spans it. A user
    with very many bookings is spread over files by the time.
    """
    order = ["user_id", "created_at", "journey_id"]
    (
        journeys.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.option("parquet.bloom.filter.enabled#user_id", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .parquet(path)
    )
    return journeys.sparkSession.read.parquet(path)


def latest_journey(journeys: DataFrame) -> DataFrame:
    """The newest booking of every user; equal times are settled by the booking id.

    The rank limit runs before the shuffle too: one row per user and task travels.
    """
    newest = W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("journey_id"))
    return journeys.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def latest_by_aggregate(journeys: DataFrame) -> DataFrame:
    """The same by partial aggregation; rows with text are aggregated in sorted order."""
    row = F.struct(*[c for c in journeys.columns if c != "user_id"])
    newest = F.max_by(row, F.struct("created_at", "journey_id"))
    return journeys.groupBy("user_id").agg(newest.alias("j")).select("user_id", "j.*")


def lookup_status() -> Column:
    return (
        F.when(F.col("user_id").isNull(), "error")
        .when(F.col("journey_id").isNull(), "not_found")
        .otherwise("success")
    )


def lookup_message() -> Column:
    return (
        F.when(F.col("user_id").isNull(), "Journey lookup not available.")
        .when(F.col("journey_id").isNull(), "No booking on file for this user.")
        .otherwise("")
    )


def journey_status(requests: DataFrame, journeys: DataFrame) -> DataFrame:
    """Every request with the booking of its user, or why there is none."""
    booked = latest_journey(
        journeys.select("user_id", "created_at", "journey_id", "pnr", "train_number", "class")
    ).drop("created_at")
    asked = requests.select("request_id", present(F.col("user_id")).alias("user_id"))
    found = lookup_join(asked, booked, "user_id", "request_id")
    return found.select(
        "request_id",
        lookup_status().alias("status"),
        lookup_message().alias("message"),
        "journey_id",
        "pnr",
        "train_number",
        "class",
    )


def fill_from_journey(requests: DataFrame, journeys: DataFrame) -> DataFrame:
    """Train and PNR of a request, taken from the user's booking where absent."""
    booked = latest_journey(
        journeys.select(
            "user_id",
            "created_at",
            "journey_id",
            F.col("pnr").alias("booked_pnr"),
            F.col("train_number").alias("booked_train"),
        )
    ).drop("created_at", "journey_id")
    asked = requests.select(
        "request_id", *[present(F.col(c)).alias(c) for c in ("user_id", "train_number", "pnr")]
    )
    return lookup_join(asked, booked, "user_id", "request_id").select(
        "request_id",
        F.coalesce("train_number", "booked_train").alias("train_number"),
        F.coalesce("pnr", "booked_pnr").alias("pnr"),
    )


BOOKED = ["journey_id", "pnr", "train_number", "class", "created_at"]


def booking_as_of(requests: DataFrame, journeys: DataFrame) -> DataFrame:
    """``request_id, asked_at`` with the user's booking as it stood at that time.

    That is the newest one made at or before the request, equal times settled by the
    booking id; a blank user has none.
    """
    asked = requests.select("request_id", present(F.col("user_id")).alias("user_id"), "asked_at")
    booked = journeys.select("user_id", *BOOKED)
    found = as_of_join(asked, booked, "user_id", "asked_at", "created_at", "journey_id", BOOKED)
    return found.withColumnRenamed("created_at", "booked_at")


def status_as_of(requests: DataFrame, journeys: DataFrame) -> DataFrame:
    """Status and message of a lookup made when the request came, with its booking."""
    found = booking_as_of(requests, journeys)
    return found.select(
        "request_id",
        lookup_status().alias("status"),
        lookup_message().alias("message"),
        "journey_id",
        "pnr",
        "train_number",
        "class",
    )


def fill_as_of(requests: DataFrame, journeys: DataFrame) -> DataFrame:
    """Train and PNR of a request, where absent from the booking of that time."""
    asked = requests.select(
        "request_id",
        "asked_at",
        present(F.col("user_id")).alias("user_id"),
        *[present(F.col(c)).alias(f"own_{c}") for c in ("train_number", "pnr")],
    )
    found = as_of_join(
        asked,
        journeys.select("user_id", "created_at", "journey_id", "train_number", "pnr"),
        "user_id",
        "asked_at",
        "created_at",
        "journey_id",
        ["train_number", "pnr"],
    )
    return found.select(
        "request_id", *[F.coalesce(f"own_{c}", c).alias(c) for c in ("train_number", "pnr")]
    )


def users_without_journey(users: DataFrame, journeys: DataFrame) -> DataFrame:
    """Users with no booking; bookings shrink to one row per user before they travel."""
    return users.join(journeys.select("user_id").distinct(), "user_id", "left_anti")


def ui_label(labels: dict[tuple[str, str], str], uses: DataFrame) -> DataFrame:
    """The label in the asked language, else in English, else the key itself."""
    flat = {f"{lang}|{key}": text for (lang, key), text in labels.items()}
    own = lookup(flat, F.concat_ws("|", "lang", "label_key"))
    english = lookup(flat, F.concat_ws("|", F.lit("en"), "label_key"))
    return uses.withColumns(
        {
            "label": F.coalesce(own, english, F.col("label_key")),
            "found_in": F.when(own.isNotNull(), "own")
            .when(english.isNotNull(), "english")
            .otherwise("none"),
        }
    )


def label_coverage(labels: dict[tuple[str, str], str], uses: DataFrame) -> DataFrame:
    """Per used language: how many used keys it has, borrows from English, or lacks."""
    pairs = uses.select("lang", "label_key").distinct()
    return ui_label(labels, pairs).groupBy("lang").agg(
        *[F.count_if(F.col("found_in") == s).alias(f"n_{s}") for s in ("own", "english", "none")]
    )
