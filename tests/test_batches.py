"""What Python tasks hold does not grow with the rows of a partition."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.operators import match as M
from recordloom.operators.vector_index import write_vector_index
from recordloom.plans import QUERIES
from recordloom.session import TEXT_ROWS
from tests.conftest import FOLDER

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def long_batches(spark):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "10000")
    yield spark
    spark.conf.set(BATCH, before)


def test_cleaning_sends_short_batches(long_batches):
    df = long_batches.createDataFrame([(1, [("é…", 1), (None, 2)]), (2, None), (3, [("ﬁ", 3)])], "id long, items array<struct<t: string, n: int>>")
    out = X.clean_frame(df)
    assert int(long_batches.conf.get(BATCH)) == TEXT_ROWS
    assert [r["items"] and [tuple(i) for i in r["items"]] for r in out.orderBy("id").collect()] == [[("é...", 1), (None, 2)], None, [("fi", 3)]]


def test_vectors_are_made_and_searched_in_short_batches(long_batches):
    df = long_batches.createDataFrame([(i, f"w{i % 7} w{i % 5} x") for i in range(60)], "id long, t string")
    vectors = M.vectorise(df, "t")
    assert int(long_batches.conf.get(BATCH)) == TEXT_ROWS
    long_batches.conf.set(BATCH, "10000")
    M.search(vectors, vectors, "id", "id", "vector", 3)
    assert int(long_batches.conf.get(BATCH)) == TEXT_ROWS


@pytest.mark.parametrize("k", [1, 7])
def test_heads_are_those_of_all_rows_whatever_the_batches(k):
    draw = np.random.default_rng(2)
    units, rows = draw.integers(0, 3, (5, 4)).astype(float), draw.integers(0, 3, (400, 4)).astype(float)
    ids = draw.permutation(400)
    whole, parts = M._Heads(np.arange(5), units, k), M._Heads(np.arange(5), units, k)
    whole.add(ids, rows)
    for i in range(0, 400, 30):
        parts.add(ids[i : i + 30], rows[i : i + 30])
    for a, b in zip(whole.columns(), parts.columns()):
        assert a.tolist() == b.tolist()


def test_few_words_are_remembered():
    assert M.KNOWN_WORDS <= 50_000


def test_an_index_is_written_in_short_batches(long_batches, tmp_path):
    df = long_batches.createDataFrame([(i, [float(i % 9 + 1), 1.0]) for i in range(40)], "id long, v array<double>")
    index = write_vector_index(df, "id", "v", str(tmp_path / "i"))
    assert int(long_batches.conf.get(BATCH)) == TEXT_ROWS and index.counts.sum() == 40


@pytest.mark.parametrize("name", ["top_k_by_comparison", "annotate_remembered"])
def test_queries_on_hits_send_short_batches(long_batches, name):
    QUERIES[name](long_batches, FOLDER)
    assert int(long_batches.conf.get(BATCH)) == TEXT_ROWS


def test_an_index_makes_every_vector_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def lengths(texts: pd.Series) -> pd.Series:
        made.add(len(texts))
        return texts.map(lambda t: [float(len(t)), 1.0 if t else 0.0])

    df = spark.createDataFrame([(i, "x" * (i % 4)) for i in range(40)], "id long, t string")
    index = write_vector_index(M.vectorise(df, "t", vectoriser=lengths), "id", "vector", str(tmp_path / "i"))
    assert made.value == 40 and index.counts.sum() == 30  # a text in four is empty


def test_a_search_gets_every_text_once_and_in_short_batches(long_batches):
    counts = [long_batches.sparkContext.accumulator(0) for _ in range(2)]

    @F.pandas_udf("array<float>")
    def lengths(texts: pd.Series) -> pd.Series:
        counts[0].add(len(texts))
        counts[1].add(len(texts) > TEXT_ROWS)
        return texts.map(lambda t: [float(len(t)), 1.0])

    df = long_batches.range(2 * TEXT_ROWS + 500, numPartitions=1).selectExpr("id", "repeat('x', cast(id % 9 as int)) as t")
    units = long_batches.createDataFrame([(1, [1.0, 0.0])], "unit long, vector array<float>")
    hits = M.search(M.vectorise(df, "t", vectoriser=lengths), units, "id", "unit", "vector", 5)
    assert [r["id"] for r in hits.orderBy("rank").collect()] == [8, 17, 26, 35, 44]
    assert [c.value for c in counts] == [2 * TEXT_ROWS + 500, 0]


def test_blocks_of_units_are_scored_in_short_batches(spark, monkeypatch):
    seen, long = (spark.sparkContext.accumulator(0) for _ in range(2))

    class Counted(M._Heads):
        def add(self, ids, vectors, only=None):
            seen.add(len(ids))
            long.add(len(ids) > TEXT_ROWS)
            super().add(ids, vectors, only)

    df = spark.range(2 * TEXT_ROWS + 500).selectExpr("id", "array(1.0D, id % 17, id % 5) as v")
    units = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i % 4)]) for i in range(8)], "unit long, v array<double>")
    whole = M.search(df, units, "id", "unit", "v", 20).collect()
    monkeypatch.setattr(M, "_Heads", Counted)
    blocks = M.search(df, units, "id", "unit", "v", 20, max_units=3).collect()
    assert sorted(blocks) == sorted(whole) and len(whole) == 160
    assert seen.value >= 2 * (2 * TEXT_ROWS + 500) and long.value == 0
    best = M.best_unit(units, df, "unit", "id", "v", max_units=3)  # the same from the other side
    assert best.count() == 8 and long.value == 0
