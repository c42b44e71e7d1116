"""Expected days for one complaint: an interval that holds, sparse groups, and batch scores."""

from __future__ import annotations

import json
import sys
from itertools import combinations

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grievaline.plans.resolution import GROUPS
from grievaline.sources.workdir import pinned

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COVER = 0.9
LEAST = 100
ERROR_UNITS = 10
PERIODS = 3
PRIOR = 30
ENOUGH = 30


def model_inputs(history: DataFrame) -> DataFrame:
    return history.withColumn("month", F.month("filed_at").cast("double"))


def fitted_trees(rows: DataFrame, seed: int = 11) -> PipelineModel:
    """Boosted trees from the groups and the month of filing to ``days``."""
    indexed = [f"{g}_index" for g in GROUPS]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=GROUPS, outputCols=indexed, handleInvalid="keep"),
            VectorAssembler(inputCols=[*indexed, "month"], outputCol="features"),
            GBTRegressor(labelCol="days", maxIter=5, maxDepth=4, seed=seed),
        ]
    ).fit(rows)


# --- intervals --------------------------------------------------------------


def period_of(filed_at: str) -> Column:
    """Months since the year 0, the step at which intervals are told anew."""
    return F.year(filed_at) * 12 + F.month(filed_at)


def margins(scored: DataFrame, group: str, cover: float = COVER, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """``period, group, n, low, middle, high``: where ``cover`` of the recent errors lie.

    Split-conformal with rolling calibration: for a period the errors ``days -
    prediction`` of the ``periods`` before it count. Of n errors those at the places
    ``floor((n + 1) a)`` and ``ceil((n + 1) (1 - a))`` bound the interval, with a half of
    what is not covered on each side, so that a slow shift of the level moves both. A null
    group stands for all rows; it serves groups with fewer than ``least``. Errors are
    counted in tenths of a day: the size depends on their range, not on the rows.
    """
    error = F.round((F.col("days") - F.col("prediction")) * ERROR_UNITS).cast("long")
    counts = scored.groupBy(period_of("filed_at").alias("at"), F.col(group).alias("group"), error.alias("error")).agg(
        F.count("*").alias("m")
    )
    serves = F.explode(F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda i: F.col("at") + i)).alias("period")
    moved = counts.select(serves, "group", "error", "m").groupBy("period", "group", "error").agg(F.sum("m").alias("m"))
    every = moved.groupBy("period", "error").agg(F.sum("m").alias("m"))
    every = every.select("period", F.lit(None).cast("string").alias("group"), "error", "m")
    both = moved.where("group IS NOT NULL").unionByName(every)
    cell = W.partitionBy("period", "group")
    placed = both.withColumn("upto", F.sum("m").over(cell.orderBy("error"))).withColumn("n", F.sum("m").over(cell))
    side = (1 - cover) / 2

    def at_place(share: float, up: bool) -> Column:
        place = F.ceil((F.col("n") + 1) * share) if up else F.floor((F.col("n") + 1) * share)
        place = F.greatest(F.least(place, F.col("n")), F.lit(1))
        return F.min(F.when(F.col("upto") >= place, F.col("error"))) / ERROR_UNITS

    found = placed.groupBy("period", "group").agg(
        F.max("n").alias("n"),
        at_place(side, False).alias("low"),
        at_place(0.5, True).alias("middle"),
        at_place(1 - side, True).alias("high"),
    )
    return found.where(F.col("group").isNull() | (F.col("n") >= least))


def fit_forecast(
    history: DataFrame, fit_until: str, path: str, group: str = "priority", cover: float = COVER
) -> None:
    """Fits before ``fit_until``, calibrates on what follows; saves both under ``path``."""
    rows = pinned(model_inputs(history.where("days >= 0")).select("filed_at", "days", *GROUPS, "month"))
    at = F.lit(fit_until).cast("timestamp_ntz")
    model = fitted_trees(rows.where(F.col("filed_at") < at))
    model.write().overwrite().save(f"{path}/model")
    scored = model.transform(rows.where(F.col("filed_at") >= at))
    margins(scored, group, cover).coalesce(1).write.mode("overwrite").parquet(f"{path}/margins")


def forecast(complaints: DataFrame, path: str, group: str = "priority") -> DataFrame:
    """``complaints`` with ``expected, low, high`` days by the saved model and margins.

    The margins of a period are of the months before it; a complaint filed behind the
    last of them takes the last, one filed before the first has no interval. A group
    without a margin of its own takes that of all rows. No interval begins below 0.
    """
    spark = complaints.sparkSession
    model = PipelineModel.load(f"{path}/model")
    names = complaints.columns
    table = spark.read.parquet(f"{path}/margins")
    last = table.agg(F.max("period")).first()[0]
    scored = model.transform(model_inputs(complaints)).select(
        *names, "prediction", F.least(period_of("filed_at"), F.lit(last).cast("int")).alias("period")
    )
    parts = ("low", "middle", "high")
    own = table.where("group IS NOT NULL").select("period", F.col("group").alias(group), *[F.col(c).alias(f"own_{c}") for c in parts])
    every = table.where("group IS NULL").select("period", *[F.col(c).alias(f"all_{c}") for c in parts])
    met = scored.join(every, "period", "left").join(own, ["period", group], "left")
    low, middle, high = (F.col("prediction") + F.coalesce(f"own_{c}", f"all_{c}") for c in parts)
    zero = F.lit(0.0)
    return met.select(
        *names,
        F.greatest(F.coalesce(middle, F.col("prediction")), zero).alias("expected"),
        F.when(low.isNotNull(), F.greatest(low, zero)).alias("low"),
        F.when(high.isNotNull(), F.greatest(high, zero)).alias("high"),
    )


def coverage(forecasts: DataFrame, group: str = "priority") -> DataFrame:
    """Per group and over all: how many rows lie in their interval, and how wide it is."""
    inside = F.col("days").between(F.col("low"), F.col("high")).cast("int")
    return forecasts.rollup(group).agg(
        F.count("*").alias("n"),
        F.avg(inside).alias("coverage"),
        F.avg(F.col("high") - F.col("low")).alias("mean_width"),
    )


# --- sparse groups ----------------------------------------------------------


def lattice() -> list[tuple[str, ...]]:
    """All sets of groups, the finest first."""
    return [c for n in range(len(GROUPS), -1, -1) for c in combinations(GROUPS, n)]


def level_of(kept: tuple[str, ...]) -> int:
    """The number that ``grouping_id`` gives to the cells that keep these groups."""
    return sum(1 << len(GROUPS) - 1 - i for i, g in enumerate(GROUPS) if g not in kept)


def cell_sums(history: DataFrame) -> DataFrame:
    """``level, n, total`` per cell of the cube over the groups, from counted days."""
    counted = history.where("days >= 0").groupBy(*GROUPS).agg(F.count("*").alias("m"), F.sum("days").alias("s"))
    return counted.cube(*GROUPS).agg(
        F.grouping_id().alias("level"), F.sum("m").alias("n"), F.sum("s").alias("total")
    )


def backed_off(asked: DataFrame, history: DataFrame, prior: int = PRIOR, enough: int = ENOUGH) -> DataFrame:
    """``asked`` with the expected days of its groups, however few complaints these have.

    ``shrunk`` walks the lattice from the whole to the finest cell: a cell's mean is drawn
    to the average of the estimates of its parents, the cells that keep one group less,
    with the weight of ``prior`` complaints. ``level, n, mean`` tell the finest cell with
    ``enough`` complaints, of equally fine ones that with more, then the smaller level;
    without such a cell it is the whole. A cell that no complaint is in takes its parents'
    average. No history gives nulls.
    """
    keys = asked.select(*GROUPS).distinct()
    cells = F.array(
        *[
            F.struct(
                F.lit(level_of(kept)).cast("bigint").alias("level"),
                *[(F.col(g) if g in kept else F.lit(None).cast("string")).alias(f"c_{g}") for g in GROUPS],
            )
            for kept in lattice()
        ]
    )
    wanted = keys.select(*GROUPS, F.inline(cells))
    sums = cell_sums(history).select("level", *[F.col(g).alias(f"s_{g}") for g in GROUPS], "n", "total")
    same = F.col("l.level") == F.col("r.level")
    for g in GROUPS:
        same = same & F.col(f"l.c_{g}").eqNullSafe(F.col(f"r.s_{g}"))
    met = wanted.alias("l").join(sums.alias("r"), same, "left").select(
        *[F.col(f"l.{g}") for g in GROUPS], "l.level", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total")
    )
    one = met.groupBy(*GROUPS).agg(
        F.map_from_entries(F.collect_list(F.struct("level", F.struct("n", "total")))).alias("cells")  # eight entries
    )
    named = {}
    for kept in reversed(lattice()):
        cell = F.col("cells")[F.lit(level_of(kept)).cast("bigint")]
        if not kept:
            value = F.when(cell["n"] > 0, cell["total"] / cell["n"])
        else:
            parents = [F.col(f"e{level_of(tuple(g for g in kept if g != out))}") for out in kept]
            average = sum(parents[1:], parents[0]) / len(parents)
            value = (cell["total"] + prior * average) / (cell["n"] + prior)
        named[kept] = f"e{level_of(kept)}"
        one = one.withColumn(named[kept], value)
    order = [
        F.struct(
            F.lit(-len(kept)).alias("kept"),
            (-F.col("cells")[F.lit(level_of(kept)).cast("bigint")]["n"]).alias("fewer"),
            F.lit(level_of(kept)).alias("level"),
            F.col("cells")[F.lit(level_of(kept)).cast("bigint")].alias("cell"),
        )
        for kept in lattice()
    ]
    finest = F.array_min(F.filter(F.array(*order), lambda c: (c["cell"]["n"] >= enough) | (c["kept"] == 0)))
    found = one.withColumn("finest", finest).select(
        *[F.col(g).alias(f"k_{g}") for g in GROUPS],
        F.round(F.col(named[tuple(GROUPS)]), 6).alias("shrunk"),
        F.col("finest.level").alias("level"),
        F.col("finest.cell.n").alias("n"),
        F.round(F.when(F.col("finest.cell.n") > 0, F.col("finest.cell.total") / F.col("finest.cell.n")), 6).alias("mean"),
    )
    match = F.lit(True)
    for g in GROUPS:
        match = match & F.col(g).eqNullSafe(F.col(f"k_{g}"))
    return asked.join(found, match).drop(*[f"k_{g}" for g in GROUPS])


# --- batch scores -----------------------------------------------------------


def exported(model: GBTRegressionModel) -> str:
    """The trees as JSON: per tree its weight and nodes in preorder.

    A node is ``[prediction]`` or ``[feature, threshold or left categories, left, right]``.
    """
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights):
        nodes: list = []

        def walk(node) -> int:
            place = len(nodes)
            nodes.append(None)
            if node.subtreeDepth() == 0:
                nodes[place] = [node.prediction()]
                return place
            split = node.split()
            by_value = "Continuous" in split.getClass().getSimpleName()
            rule = split.threshold() if by_value else sorted(split.leftCategories())
            nodes[place] = [split.featureIndex(), rule, walk(node.leftChild()), walk(node.rightChild())]
            return place

        walk(tree._call_java("rootNode"))
        trees.append({"weight": weight, "nodes": nodes})
    return json.dumps(trees)


class Trees:
    """Boosted trees that score a matrix of features at once."""

    def __init__(self, text: str):
        self.trees = [(t["weight"], t["nodes"]) for t in json.loads(text)]

    def __call__(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros(len(features))
        for weight, nodes in self.trees:
            total += weight * self.one(nodes, features)
        return total

    @staticmethod
    def one(nodes: list, features: np.ndarray) -> np.ndarray:
        found = np.zeros(len(features))
        left_over = [(0, np.arange(len(features)))]
        while left_over:
            place, rows = left_over.pop()
            node = nodes[place]
            if len(node) == 1:
                found[rows] = node[0]
                continue
            feature, rule, left, right = node
            value = features[rows, feature]
            goes = np.isin(value, rule) if isinstance(rule, list) else value <= rule
            left_over += [(left, rows[goes]), (right, rows[~goes])]
        return found


def batch_scores(complaints: DataFrame, path: str, batch_rows: int = 4096) -> DataFrame:
    """``complaints`` with ``expected`` days by the saved model, scored in Python workers.

    Indexing and assembling stay in the JVM; the saved trees travel as a text of a few
    kilobytes, from which each worker makes its model once, and score Arrow batches.
    """
    loaded = PipelineModel.load(f"{path}/model")
    features = PipelineModel(stages=loaded.stages[:-1]).transform(model_inputs(complaints))
    text, n = exported(loaded.stages[-1]), loaded.stages[-1].numFeatures

    def make():
        return Trees(text)

    score = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch_rows, input_tensor_shapes=[[n]])
    return features.select(*complaints.columns, score(vector_to_array("features")).alias("expected"))


# --- drift over time --------------------------------------------------------

BINS = 10
SKETCH = 1000
MAX_FEATURES = 256


def daily_sketches(rows: DataFrame, feature: str, value: str, time: str, delay: str = "1 day") -> DataFrame:
    """``feature, day, sketch, n``: a quantile sketch per feature and day, batch or stream.

    A stream gives a day once, when the watermark has passed it; rows later than ``delay``
    are left out. Partial sketches are merged, no row is shuffled.
    """
    if rows.isStreaming:
        rows = rows.withWatermark(time, delay)
    day = F.window(time, "1 day")
    return (
        rows.where(F.col(value).isNotNull())
        .groupBy(F.col(feature).alias("feature"), day)
        .agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH)).alias("sketch"), F.count("*").alias("n"))
        .select("feature", F.col("window.start").alias("day"), "sketch", "n")
    )


def sliding_drift(sketches: DataFrame, until: str, days: int = 7, bins: int = BINS) -> DataFrame:
    """``feature, day, n, psi``: how far the ``days`` days from each day lie from the time before ``until``.

    All windows are merged from the daily sketches. Bins end at the quantiles of the
    reference, which are collected: ``bins`` numbers a feature, for at most
    ``MAX_FEATURES`` features. A bin counts at least half a row, so that an empty one
    stays finite.
    """
    at = F.lit(until).cast("timestamp")
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    reference = (
        sketches.where(F.col("day") < at)
        .groupBy("feature")
        .agg(F.kll_merge_agg_double("sketch").alias("reference"), F.sum("n").alias("n_reference"))
    )
    edges = reference.select("feature", F.array_distinct(F.kll_sketch_get_quantile_double("reference", shares)).alias("edges")).limit(MAX_FEATURES + 1).collect()
    if len(edges) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_sub(F.col("day").cast("date"), i)))
    windows = (
        sketches.select("feature", "sketch", "n", starts.alias("start"))
        .where(F.col("start") >= at.cast("date"))
        .groupBy("feature", "start")
        .agg(F.kll_merge_agg_double("sketch").alias("current"), F.sum("n").alias("n"))
    )

    def ranks(sketch: str) -> Column:
        """The share of values up to each edge of the row's feature."""
        found = F.lit(None).cast("array<double>")
        for r in edges:
            found = F.when(
                F.col("feature").eqNullSafe(F.lit(r["feature"])),
                F.kll_sketch_get_rank_double(sketch, F.array(*[F.lit(float(e)) for e in r["edges"]])),
            ).otherwise(found)
        return found

    def in_bins(upto: str, n: str) -> Column:
        whole = F.concat(F.array(F.lit(0.0)), F.col(upto), F.array(F.lit(1.0)))
        counts = F.transform(
            F.sequence(F.lit(1), F.size(whole) - 1),
            lambda i: F.greatest((F.get(whole, i) - F.get(whole, i - 1)) * F.col(n), F.lit(0.5)),
        )
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.transform(counts, lambda c: c / total)

    before = reference.select("feature", "n_reference", ranks("reference").alias("upto_before"))
    now = windows.select("feature", "start", "n", ranks("current").alias("upto"))
    both = now.join(before, "feature").withColumns({"q": in_bins("upto", "n"), "p": in_bins("upto_before", "n_reference")})
    terms = F.zip_with("p", "q", lambda p, q: (q - p) * F.log(q / p))
    return both.select(
        "feature", F.col("start").alias("day"), "n", F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 6).alias("psi")
    )
