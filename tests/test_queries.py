"""Every registered query against its SQL, on the smallest tables."""

import pytest

from recordloom.plans import ORACLES, QUERIES
from tests.conftest import FOLDER
from tests.oracle import compare


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    """Same rows, same column types, and no cross join in the plan."""
    made = []

    def run(spark, folder):
        made.append(QUERIES[name](spark, folder))
        return made[0]

    got, want = compare(spark, con, FOLDER, name, run, ORACLES[name])
    assert got == want
    types = {r[0]: r[1] for r in con.execute("describe " + ORACLES[name]).fetchall()}
    assert {c: TYPES[t] for c, t in made[0].dtypes} == types
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_is_the_cascade(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["item_id", "doc_id", "rank", "score", "rerank_score", "recommendation_reason"]
    assert df.count() > 0
    assert set(QUERIES) == set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
