"""Every registered query against its SQL, and the shape of the registry."""

import pytest
from compare import connect, difference
from conftest import SMALL

import __spark_entry__ as entry_points
from grievaline import catalogue

QUERIES = catalogue.queries()
ORACLE = catalogue.oracle_sql()
# Files, random ids, approximate search and fitted models have no SQL form.
ROWS_ONLY = {
    "image_file_source",
    "journey_ids",
    "topk_lsh",
    "topk_lsh_recall",
    "rule_search_blocks",
    "text_to_vector",
    "resolution_model",
    "resolution_forecast",
    "model_scores",
    "drift_windows",
}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_is_compared():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    frame = QUERIES[name](spark, SMALL)
    assert difference(frame, con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_gives_rows(spark, name):
    frame = QUERIES[name](spark, SMALL)
    assert frame.columns and frame.count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"chunk_table_overwrite"}))
def test_no_pairing_of_everything(spark, name):
    """No plan joins without keys."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
