"""The physical plans are the ones meant."""

import pytest

from recordloom.operators import match as M
from recordloom.plans import QUERIES
from tests.conftest import FOLDER


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, name):
    return plan_of(QUERIES[name](spark, FOLDER))


def test_diff_reads_three_columns_and_pushes_filters(spark):
    text = plan(spark, "snapshot_diff")
    assert "o_totalprice" not in text and "o_custkey" not in text
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,P))" in text


def test_label_merge_combines_in_hash_aggregates(spark):
    text = plan(spark, "merge_labels")
    assert "partial_min" in text and "SortAggregate" not in text


def test_first_wins_combines_before_the_shuffle(spark):
    assert "partial_min_by" in plan(spark, "first_wins")


def test_top_k_is_cut_before_each_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id", "id * 7 % 13 as v")
    text = plan_of(M.rank_per_unit(df, "g", "v", "id", 50))
    assert text.count("WindowGroupLimit") >= 2


def test_vectoriser_runs_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, t string")
    found = M.search(M.vectorise(df, "t"), M.vectorise(df, "t"), "id", "id", "vector", k=1)
    assert plan_of(found).count("vectorise(") == 1


@pytest.mark.parametrize("name", ["clock_24h", "coded_links", "validate_fields", "company_url", "oral_fields"])
def test_column_jobs_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_calendar_shuffles_pages_once(spark):
    assert plan(spark, "exhibitor_talks").count("Exchange hashpartitioning(page_id") <= 2


def test_a_small_side_needs_no_sketch(spark):
    text = plan(spark, "fill_missing")
    assert "approx_top_k" not in text and text.count("customer.parquet") == 1


def test_nothing_keeps_blocks_on_one_machine():
    import pathlib

    for path in pathlib.Path("recordloom").rglob("*.py"):
        code = path.read_text()
        assert "localCheckpoint" not in code and "crossJoin" not in code, path
