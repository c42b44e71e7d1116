"""Intervals that hold, sparse groups, scores in workers, and drift from sketches."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import SMALL
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from grievaline import catalogue
from grievaline.plans import forecast
from grievaline.queries_search import history
from grievaline.sources.sinks import write_batch
from grievaline.streaming.runs import run_stream

MIDDLE = "/root/testdata/sf0.01"
QUERIES = catalogue.queries()
START = datetime(2024, 1, 1)


def test_ninety_of_a_hundred_lie_in_their_interval(spark):
    rows = QUERIES["resolution_forecast"](spark, MIDDLE).collect()
    (whole,) = [r for r in rows if r["priority"] is None]
    assert whole["n"] > 2000 and 0.88 <= whole["coverage"] <= 0.92
    assert len(rows) == 6 and all(0.85 <= r["coverage"] <= 0.95 for r in rows)


def test_margins_are_the_placed_errors(spark):
    rng = random.Random(1)
    rows = [(START + timedelta(days=rng.randint(0, 120)), "a" if i % 3 else "b", rng.randint(0, 90), 40.0) for i in range(600)]
    frame = spark.createDataFrame(rows, "filed_at timestamp, g string, days int, prediction double")
    got = {(r["period"], r["group"]): r for r in forecast.margins(frame, "g", 0.9, least=50, periods=2).collect()}

    def month(at):
        return at.year * 12 + at.month

    for period in {month(r[0]) + i for r in rows for i in (1, 2)}:
        for group in ("a", "b", None):
            errors = sorted(d - p for at, g, d, p in rows if month(at) in (period - 1, period - 2) and group in (g, None))
            if group is not None and len(errors) < 50:
                assert (period, group) not in got
                continue
            n = len(errors)
            r = got[period, group]
            places = (int((n + 1) * 0.05), -int(-(n + 1) * 0.5 // 1), -int(-(n + 1) * 0.95 // 1))
            assert (r["low"], r["middle"], r["high"]) == tuple(errors[min(max(p, 1), n) - 1] for p in places) and r["n"] == n


def test_backing_off_by_hand(spark):
    cells = [("n", "x", "1", 40, 10), ("n", "x", "2", 1, 100), ("s", "y", "1", 200, 4)]
    rows = [(*c[:3], c[4]) for c in cells for _ in range(c[3])]
    past = spark.createDataFrame(rows, "zone string, category string, priority string, days int")
    asked = spark.createDataFrame([("n", "x", "1"), ("n", "x", "2"), ("w", "z", "9"), ("n", None, "1")], "zone string, category string, priority string")
    got = {(r["zone"], r["category"], r["priority"]): r for r in forecast.backed_off(asked, past).collect()}
    assert len(got) == 4
    many, one, none = got["n", "x", "1"], got["n", "x", "2"], got["w", "z", "9"]
    assert (many["level"], many["n"], many["mean"]) == (0, 40, 10.0)
    assert one["level"] == 1 and one["n"] == 41 and one["mean"] == pytest.approx(500 / 41, abs=1e-6)
    whole = (400 + 100 + 800) / 241
    assert (none["level"], none["n"]) == (7, 241) and none["shrunk"] == pytest.approx(whole, abs=1e-6)
    assert 9 < many["shrunk"] < one["shrunk"] < 100
    # from the whole through two parents to the finest cell, by the same rule
    up = lambda total, n, parent: (total + 30 * parent) / (n + 30)
    z, c, p = up(500, 41, whole), up(500, 41, whole), up(100, 1, whole)
    zc, zp, cp = up(500, 41, (z + c) / 2), up(100, 1, (z + p) / 2), up(100, 1, (c + p) / 2)
    assert one["shrunk"] == pytest.approx(up(100, 1, (zc + zp + cp) / 3), abs=1e-6)
    assert forecast.backed_off(asked, past.where("false")).where("shrunk IS NOT NULL OR mean IS NOT NULL").count() == 0


def test_scores_in_workers_equal_the_model(spark, tmp_path):
    path, rows = str(tmp_path), history(spark, SMALL).cache()
    forecast.fit_forecast(rows, "1998-01-01 00:00:00", path)
    asked = rows.select("complaint_id", "zone", "category", F.when(F.col("complaint_id") % 9 == 0, "new").otherwise(F.col("priority")).alias("priority"), "filed_at")
    got = {r["complaint_id"]: r["expected"] for r in forecast.batch_scores(asked, path, batch_rows=100).collect()}
    model = PipelineModel.load(f"{path}/model")
    want = {r["complaint_id"]: r["prediction"] for r in model.transform(forecast.model_inputs(asked)).collect()}
    assert got.keys() == want.keys() and len(set(got.values())) > 5
    assert max(abs(got[k] - want[k]) for k in want) <= 1e-9


def test_model_errors_by_value(spark):
    """The stored errors are those of the trees that the definition gives, fitted here anew."""
    (row,) = QUERIES["resolution_model"](spark, SMALL).collect()
    rows = forecast.model_inputs(history(spark, SMALL).where("days >= 0")).cache()
    at = F.lit("1997-01-01").cast("timestamp_ntz")
    model = forecast.fitted_trees(rows.where(F.col("filed_at") < at))
    errors = [r["days"] - r["prediction"] for r in model.transform(rows.where(F.col("filed_at") >= at)).collect()]
    assert row["n_test"] == len(errors) > 100
    assert row["mae"] == pytest.approx(np.mean(np.abs(errors)), rel=1e-3)
    assert row["rmse"] == pytest.approx(np.sqrt(np.mean(np.square(errors))), rel=1e-3)


EVENTS = "feature string, value double, ts timestamp"


def events(n=6000, seed=5):
    rng = np.random.default_rng(seed)
    days = rng.integers(0, 30, n)
    values = rng.normal(size=n) + np.where(days >= 20, 0.4, 0.0)
    return [("f" if i % 3 else "g", float(v), START + timedelta(days=int(d), minutes=int(i % 1400))) for i, (d, v) in enumerate(zip(days, values))]


def exact_psi(rows, feature, start, days=7, split=10, bins=10):
    before = np.sort([v for f, v, at in rows if f == feature and at < START + timedelta(days=split)])
    now = np.array([v for f, v, at in rows if f == feature and start <= at < start + timedelta(days=days)])
    edges = np.unique([before[max(int(np.ceil(len(before) * i / bins)) - 1, 0)] for i in range(1, bins)])

    def shares(values):
        counts = np.maximum(np.histogram(values, bins=np.concatenate([[-np.inf], np.nextafter(edges, np.inf), [np.inf]]))[0], 0.5)
        return counts / counts.sum()

    p, q = shares(before), shares(now)
    return float(((q - p) * np.log(q / p)).sum()), len(now)


def test_drift_from_merged_sketches(spark):
    rows = events()
    found = []
    for parts in (1, 7):  # partial sketches merge in another order
        frame = spark.createDataFrame(rows, EVENTS).repartition(parts)
        sketches = forecast.daily_sketches(frame, "feature", "value", "ts")
        found.append({(r["feature"], r["day"]): r for r in forecast.sliding_drift(sketches, "2024-01-11").collect()})
    for key, r in found[0].items():
        psi, n = exact_psi(rows, key[0], datetime.combine(key[1], datetime.min.time()))
        assert abs(r["psi"] - psi) <= 0.01 and abs(found[1][key]["psi"] - psi) <= 0.01 and r["n"] == n
    assert max(r["psi"] for k, r in found[0].items() if k[1].day >= 21) > 0.05


def test_a_late_day_closes_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = sorted(events(1500), key=lambda r: r[2])
    late = [("f", 9.0, START + timedelta(days=2))] * 5  # comes behind the watermark
    parts = [rows[:500], rows[500:1000] + late, rows[1000:], [("f", 0.0, START + timedelta(days=60))]]
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        run_stream(
            forecast.daily_sketches(stream, "feature", "value", "ts"),
            lambda batch, n: write_batch(batch, target, n),
            str(tmp_path / "cp"),
        )
    days = spark.read.parquet(target)
    assert days.count() == days.select("feature", "day").distinct().count() == 60
    assert days.agg(F.sum("n")).first()[0] == 1500
