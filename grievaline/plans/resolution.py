"""Resolution times: expected days, subtotals, a model and drift; token usage."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grievaline.operators.hotkeys import lookup_join
from grievaline.sources.workdir import pinned

GROUPS = ["zone", "category", "priority"]
QUANTILES = [0.1, 0.5, 0.9]


def resolution_history(
    orders: DataFrame, lineitem: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """One row per closed complaint; ``days`` is negative for records out of order.

    Lines shrink to one row per order before the join, and a customer with very many
    orders is spread. The small tables carry no hint: their measured size decides
    whether they are broadcast.
    """
    closed = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("closed_at")
    )
    places = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "r_name")
    )
    filed = orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return (
        lookup_join(filed, places, "o_custkey", "o_orderkey")
        .where("r_name IS NOT NULL")
        .join(closed, "o_orderkey")
        .select(
            F.col("o_orderkey").alias("complaint_id"),
            F.col("r_name").alias("zone"),
            F.col("c_mktsegment").alias("category"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderdate").alias("filed_at"),
            F.datediff("closed_at", "o_orderdate").alias("days"),
        )
    )


def counted_days(history: DataFrame) -> DataFrame:
    """Complaints per group and number of days: what all quantiles are made of.

    The size depends on the groups and the range of days, not on the history.
    """
    return history.where("days >= 0").groupBy(*GROUPS, "days").agg(F.count("*").alias("m"))


def interval_columns() -> list:
    """Count, expected days and the interval, exact, from counted days."""
    points = F.percentile("days", F.array(*[F.lit(q) for q in QUANTILES]), F.col("m"))
    return [
        F.sum("m").alias("n"),
        F.round(points[0], 6).alias("low"),
        F.round(points[1], 6).alias("expected"),
        F.round(points[2], 6).alias("high"),
    ]


def resolution_interval(history: DataFrame) -> DataFrame:
    return counted_days(history).groupBy(*GROUPS).agg(*interval_columns())


def resolution_cube(history: DataFrame) -> DataFrame:
    """The same over every combination of groups; ``level`` tells which are rolled up."""
    return (
        counted_days(history)
        .cube(*GROUPS)
        .agg(F.grouping_id().alias("level"), *interval_columns())
    )


def feature_drift(history: DataFrame, split: str, width: int = 10) -> DataFrame:
    """Population stability index of each group column and of ``days``, in two periods.

    Every value counts at least half a row, so that an unseen one stays finite.
    """
    later = F.col("filed_at") >= F.lit(split).cast("timestamp_ntz")
    binned = history.where("days >= 0").select(
        later.alias("later"),
        *GROUPS,
        F.lpad(F.floor(F.col("days") / width).cast("string"), 6, "0").alias("days"),
    )
    features = [*GROUPS, "days"]
    # Counted before the columns become rows, so that no row is multiplied.
    tallies = binned.groupBy("later", *features).agg(F.count("*").alias("m"))
    counts = (
        tallies.unpivot(["later", "m"], features, "feature", "value")
        .groupBy("feature", "value")
        .agg(
            F.sum(F.when(F.col("later"), 0).otherwise(F.col("m"))).alias("n_before"),
            F.sum(F.when(F.col("later"), F.col("m")).otherwise(0)).alias("n_after"),
        )
    )
    totals = counts.groupBy("feature").agg(
        F.sum(F.greatest("n_before", F.lit(0.5))).alias("t_before"),
        F.sum(F.greatest("n_after", F.lit(0.5))).alias("t_after"),
    )
    p = F.greatest("n_before", F.lit(0.5)) / F.col("t_before")
    q = F.greatest("n_after", F.lit(0.5)) / F.col("t_after")
    return (
        counts.join(F.broadcast(totals), "feature")  # one row per feature: four
        .groupBy("feature")
        .agg(F.count("*").alias("n_values"), F.round(F.sum((q - p) * F.log(q / p)), 6).alias("psi"))
    )


def resolution_model(history: DataFrame, split: str, path: str, seed: int = 11) -> DataFrame:
    """Boosted trees fitted before ``split`` and saved; returns their error after it.

    ``path/model`` holds the fitted pipeline, ``path/metrics`` a row per fit.
    """
    rows = history.where("days >= 0").withColumn("month", F.month("filed_at").cast("double"))
    at = F.lit(split).cast("timestamp_ntz")
    indexed = [f"{g}_index" for g in GROUPS]
    rows = pinned(rows.select("filed_at", "days", *GROUPS, "month"))
    train, test = rows.where(F.col("filed_at") < at), rows.where(F.col("filed_at") >= at)
    model = Pipeline(
        stages=[
            StringIndexer(inputCols=GROUPS, outputCols=indexed, handleInvalid="keep"),
            VectorAssembler(inputCols=[*indexed, "month"], outputCol="features"),
            GBTRegressor(labelCol="days", maxIter=5, maxDepth=4, seed=seed),
        ]
    ).fit(train)
    scored = model.transform(test).select("days", "prediction")
    error = F.col("days") - F.col("prediction")
    metrics = scored.agg(
        F.count("*").alias("n_test"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("append").parquet(f"{path}/metrics")
    return history.sparkSession.read.parquet(f"{path}/metrics")


def token_usage(usage: DataFrame) -> DataFrame:
    """Tokens per model and day, with subtotals per model and over all."""
    return usage.rollup("model", "day").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )
