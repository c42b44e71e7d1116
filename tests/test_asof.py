"""The point-in-time join against brute force, with hot users, ties and gaps."""

import random
from datetime import datetime, timedelta

import pytest

from grievaline.operators.asof import as_of_join
from grievaline.plans import bookings

START = datetime(2024, 1, 1)


def sides(n=1500, seed=2):
    rng = random.Random(seed)

    def user():
        return rng.choice(["hot", rng.choice(["hot", f"u{rng.randint(0, 60)}"]), f"u{rng.randint(0, 60)}", None])

    def time():
        return None if rng.random() < 0.03 else START + timedelta(hours=rng.randint(0, 400))

    left = [(i, user(), time()) for i in range(n)]
    right = [(user(), time(), rng.choice([None, f"j{rng.randint(0, 99):02d}"]), i) for i in range(n // 2)]
    return left, right


def brute(left, right):
    found = {}
    for i, user, at in left:
        seen = [r for r in right if r[0] == user and user is not None and r[1] is not None and at is not None and r[1] <= at]
        best = max(((r[1], r[2] is not None, r[2] or "") for r in seen), default=None)
        found[i] = best and (best[0], best[2] if best[1] else None)
    return found


@pytest.mark.parametrize("floor", [16, 200, 1 << 18])
def test_as_of_join(spark, floor):
    left, right = sides()
    a = spark.createDataFrame(left, "i int, user string, asked timestamp")
    b = spark.createDataFrame(right, "user string, at timestamp, id string, n int")
    got = as_of_join(a, b, "user", "asked", "at", "id", ["at", "id"], floor=floor)
    assert got.columns == ["i", "user", "asked", "at", "id"]
    found = {r["i"]: None if r["at"] is None else (r["at"], r["id"]) for r in got.collect()}
    assert found == brute(left, right) and got.count() == len(left)


def test_no_earlier_booking_and_equal_times(spark):
    asked = spark.createDataFrame(
        [("a", "1", START), ("b", "1", START - timedelta(days=1)), ("c", " ", START), ("d", "2", None)],
        "request_id string, user_id string, asked_at timestamp",
    )
    journeys = spark.createDataFrame(
        [("7", "1", START, "p", "t", "3A"), ("8", "1", START, "p", "t", "2A"), ("9", "1", START + timedelta(1), "p", "t", "1A")],
        "journey_id string, user_id string, created_at timestamp, pnr string, train_number string, class string",
    )
    got = {r["request_id"]: (r["status"], r["journey_id"]) for r in bookings.status_as_of(asked, journeys).collect()}
    assert got == {"a": ("success", "8"), "b": ("not_found", None), "c": ("error", None), "d": ("not_found", None)}
    assert bookings.status_as_of(asked.where("false"), journeys).count() == 0
    assert bookings.status_as_of(asked, journeys.where("false")).where("status = 'success'").count() == 0


def test_nothing_is_joined_on_a_range(spark):
    left, right = sides(200)
    a = spark.createDataFrame(left, "i int, user string, asked timestamp")
    b = spark.createDataFrame(right, "user string, at timestamp, id string, n int")
    plan = as_of_join(a, b, "user", "asked", "at", "id", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window") >= 1
