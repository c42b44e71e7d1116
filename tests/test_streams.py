"""Streams with state: late, repeated and out-of-order rows, restarts, bounded state."""

import os
from datetime import datetime, timedelta

import pytest
from compare import files_read
from pyspark.sql import Row
from pyspark.sql import functions as F

from grievaline.plans import rules
from grievaline.sources.sinks import read_or_none
from grievaline.streaming import bookings, index, registrations

START = datetime(2024, 1, 1)
USERS = "user_id string, phone string, registered_at timestamp"


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def opened(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def phone(n):
    return f"9{n:09d}"


def test_late_repeated_and_unordered_registrations(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    hours = lambda h: START + timedelta(hours=h)
    sizes, every = [], []
    for trigger in range(6):
        first = trigger * 48
        rows = [(f"u{trigger}-{i}", phone(i), hours(first + i % 24)) for i in range(40)]
        rows += [(f"u{trigger}-{i}", phone(900 + i), hours(first + 23)) for i in range(10)]  # repeats
        rows += [(f"x{trigger}", phone(1), hours(first - 20))]  # out of order, within the delay
        rows += [(f"bad{trigger}", "phone", hours(first))]
        if trigger > 1:
            rows += [(f"late{trigger}", phone(2), hours(first - 90)), (f"u{trigger - 2}-0", phone(3), hours(first - 90))]
            rows += [("u0-1", phone(4), hours(first + 1))]  # a repeat that the state has forgotten
        every += rows
        arrive(spark, source, rows, USERS)
        query = registrations.registration_stream(opened(spark, source, USERS), target, checkpoint)
        sizes.append(sum(o["numRowsTotal"] for p in query.recentProgress[-1:] for o in p["stateOperators"]))
    users = spark.read.parquet(f"{target}/users")
    late = {r["user_id"] for r in spark.read.parquet(f"{target}/late").collect()}
    assert late == {f"late{t}" for t in range(2, 6)} | {f"u{t - 2}-0" for t in range(2, 6)}
    valid = {r[0] for r in every if r[1] != "phone"}
    got = [r["user_id"] for r in users.collect()]
    assert len(got) == len(set(got)) and set(got) == {u for u in valid if not u.startswith("late")}
    assert spark.read.parquet(f"{target}/answers").count() == len(every)
    assert max(sizes[2:]) <= 3 * 42, sizes  # users of six triggers, state of a few
    # a user's earliest row counts, also where the repeat came in the same batch
    assert {r["phone_number"] for r in users.where("user_id = 'u1-5'").collect()} == {phone(5)}
    for _ in range(2):
        registrations.insert_late(spark, target, "late-1")
    got = [r["user_id"] for r in spark.read.parquet(f"{target}/users").collect()]
    assert sorted(got) == sorted(valid)


def test_inserts_read_the_slots_of_their_users(spark, tmp_path):
    target = str(tmp_path / "out")
    rows = spark.range(400).select(F.concat(F.lit("u"), "id").alias("user_id"), F.lit("9").alias("phone_number"), F.lit(START).alias("registered_at"))
    registrations.insert_missing(rows, target, "b0")
    held = spark.read.parquet(f"{target}/users")
    slot = rows.where("user_id = 'u7'").select(registrations.slot_of("user_id")).first()[0]
    assert 0 < files_read(held.where(F.col("slot").isin([slot]))) < len(held.inputFiles()) / 10
    registrations.insert_missing(rows.where("user_id IN ('u7', 'u8')"), target, "b1")
    assert spark.read.parquet(f"{target}/users").count() == 400


JOURNEYS = "journey_id string, user_id string, created_at timestamp, class string"


def newest(rows):
    best = {}
    for j, u, at, kind in rows:
        if u is not None and (u not in best or (at, j) > (best[u][1], best[u][0])):
            best[u] = (j, at, kind)
    return {u: (b[0], b[2]) for u, b in best.items()}


def test_booking_changes_keep_state_over_restarts(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    batches = [
        [(f"j{i}", f"u{i % 20}", START + timedelta(days=i), "3A") for i in range(60)],
        [("k1", "u1", START, "1A"), ("k2", "u2", START + timedelta(days=900), "2A"), ("k3", None, START, "SL")],
        [("k4", "u2", START + timedelta(days=900), "3A"), ("a0", "u2", START + timedelta(days=900), "SL")],
    ]
    seen = []
    for rows in batches:
        arrive(spark, source, rows, JOURNEYS)
        seen += rows
        # every call starts the query anew from its checkpoint
        bookings.booking_changes(opened(spark, source, JOURNEYS), target, checkpoint)
        log = spark.read.parquet(target)
        got = {r["user_id"]: (r["journey_id"], r["class"]) for r in bookings.current_journeys(log).collect()}
        assert got == newest(seen)
    written = {r["batch"]: r["count"] for r in log.groupBy("batch").count().collect()}
    assert sorted(written.values()) == [1, 1, 20]  # changes only


def test_users_leave_the_booking_state_behind_the_watermark(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    sizes, seen = [], []
    for trigger in range(5):
        rows = [(f"j{trigger}-{i}", f"u{trigger}-{i}", START + timedelta(days=30 * trigger), "3A") for i in range(30)]
        rows += [(f"h{trigger}", "u0-0", START + timedelta(days=30 * trigger), "2A")]
        seen += rows
        arrive(spark, source, rows, JOURNEYS)
        query = bookings.booking_changes(
            opened(spark, source, JOURNEYS), target, checkpoint, delay="2 days", keep_ms=3 * 86_400_000
        )
        sizes.append([o["customMetrics"].get("numValueStateVars") for p in query.recentProgress for o in p["stateOperators"]] and sum(
            o["numRowsTotal"] for p in query.recentProgress[-1:] for o in p["stateOperators"]
        ))
    log = spark.read.parquet(target)
    got = {r["user_id"]: (r["journey_id"], r["class"]) for r in bookings.current_journeys(log).collect()}
    assert got == newest(seen)
    assert sizes[-1] <= 2 * sizes[0], sizes  # the users of five months, the state of the last


def folders(path):
    return {f: os.stat(os.path.join(path, f)).st_mtime_ns for f in os.listdir(path) if f.startswith("slot=")}


def test_a_small_sync_touches_its_slots_only(spark, tmp_path):
    path = str(tmp_path / "index")
    old = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("rule "), "id").alias("text"))
    index.sync_index(old, path, 0, whole=True)
    new = old.withColumn("text", F.when(F.col("doc_id") % 100 == 7, F.concat("text", F.lit(" new"))).otherwise(F.col("text")))
    new = new.where("doc_id <> 50")
    changed = [7, 50, 107, 207, 307]
    slots = set(index.slots_of(spark.createDataFrame([(d,) for d in changed], "doc_id bigint")))
    before = folders(path)
    index.sync_index(new, path, 1, whole=True)
    after = folders(path)
    assert {int(f[5:]) for f in after if after[f] != before.get(f)} == slots
    live = index.live_index(spark, path)
    unit = rules.CHUNKS_PER_TEXT
    assert {r["id"] // unit for r in live.where("batch = 1").collect()} == set(changed) - {50}
    assert live.count() == 399
    # what a sync of few documents reads is told by the partition filter
    plan = index.touched_slots(spark, path, sorted(slots))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slot" in plan
    assert files_read(index.touched_slots(spark, path, sorted(slots))) == len(slots)
    # an unchanged document writes nothing; a later change sweeps the mark of the withdrawn chunk
    index.sync_index(new.where("doc_id = 3"), path, 2, whole=False)
    assert folders(path) == after
    assert read_or_none(spark, path).where("gone").count() == 1


@pytest.mark.parametrize("whole", [True, False])
def test_withdrawn_chunks_come_back_once(spark, tmp_path, whole):
    path, schema = str(tmp_path / "index"), "doc_id bigint, text string"
    long, short = [(1, "y " * 600)], [(1, "short")]
    for batch, rows in enumerate([long, short, long, short, long]):
        index.sync_index(spark.createDataFrame(rows, schema), path, batch, whole)
        ids = [r["id"] for r in index.live_index(spark, path).collect()]
        assert len(ids) == len(set(ids)) == (1 if rows is short else 3)


def test_newest_booking_takes_rows_as_they_are():
    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, row):
            self.held = row

    processor = bookings.NewestBooking(["v0", "v1", "v2"], "", None)
    processor.newest = Value()
    row = Row("user_id", "v1", "v0", "v2")
    assert list(processor.handleInputRows(("u",), iter([row("u", "a", 5, "x"), row("u", "b", 7, "y"), row("u", "c", 6, "z")]), None)) == [
        Row(user_id="u", v0=7, v1="b", v2="y")
    ]
    assert processor.newest.held == (7, "b", "y")
    assert list(processor.handleInputRows(("u",), iter([row("u", "a", 7, "x")]), None)) == []
