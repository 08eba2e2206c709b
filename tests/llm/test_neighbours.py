"""The permutation index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import permutation_index
from recordloom.llm.permutation_index import nearest_vectors, op9_permutation_index
from tests.conftest import FOLDER
from tests.llm.tables import CLASH


def brute(rows, queries, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    fine = list({i: (i, v) for i, v in fine}.values())
    out = {}
    for i, q in fine:
        if i in queries:
            scores = sorted(((-float(sum(a * b for a, b in zip(q, v))), j) for j, v in fine if j != i))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_odd_vectors_and_few_rows(spark):
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32([i % 3, 1.0, -i])) for i in range(12)] + [(i, f32([1, 2, 3])) for i in range(12, 16)]
    odd = [(20, None), (21, [0.0, 0.0, 0.0]), (22, [1.0, None, 2.0]), (23, [float("nan"), 1.0, 1.0]), (24, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (3, rows[3][1])]
    df = table(spark, rows + odd)
    got = found(nearest_vectors(df, df.filter("vec_id % 2 = 0"), 20))
    assert got == brute(rows, set(range(0, 16, 2)), 20)
    assert nearest_vectors(df.limit(0), df.limit(0)).count() == 0
    assert nearest_vectors(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 100])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(permutation_index, "FILE_BLOCK", block)
    monkeypatch.setattr(permutation_index, "QUERY_BLOCK", max(10, block // 20))
    got = found(op9_permutation_index(spark, FOLDER))
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(len(v) == 20 for v in got.values()) and got.keys() == want.keys()
    scores = {(q, j): s for q, v in brute(rows, set(want), 10**6).items() for j, s in v}
    assert all(s == scores[q, j] for q, v in got.items() for j, s in v)


def test_copies_of_one_vector_come_in_order(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 600)]
    df = table(spark, rows)
    got = found(nearest_vectors(df, df.filter("vec_id = 0"), 20))
    assert [j for j, _ in got[0]] == list(range(300, 320))


def test_every_length_is_searched(spark):
    """One longer vector does not hide the others, nor is a length of a few rows left out."""
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100, [1.0] * 9)] + [(200 + i, [float(i), 1.0]) for i in range(4)]
    df = table(spark, rows)
    got = found(nearest_vectors(df, df, 5))
    assert len(got) == 64 and 100 not in got and all(len(v) == 5 for i, v in got.items() if i < 60)
    assert all({j for j, _ in v} < set(range(60)) for i, v in got.items() if i < 60)
    assert [j for j, _ in got[203]] == [202, 201, 200]


def test_recall_on_ten_times_the_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = found(op9_permutation_index(spark, folder))
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    hits = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]].tolist()) & {j for j, _ in got[ids[at]]})
    assert hits >= 0.92 * 20 * (ids % 20 == 0).sum()
