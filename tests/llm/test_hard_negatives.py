"""Hard negatives against brute force, and the walk over cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import hard_negatives as module
from recordloom.llm.hard_negatives import Book, _next_cells, cells_in_order, hard_negatives, op11_hard_negatives
from tests.conftest import FOLDER
from tests.llm.tables import CLASH


def brute(rows, anchors, k=5, window=(80, 100)):
    """rows: (vec_id, label, whole components); as hard_negatives returns them."""
    fine = [r for r in dict.fromkeys((i, lab, None if v is None else tuple(v)) for i, lab, v in rows) if None not in r and r[2] and None not in r[2] and np.isfinite(r[2]).all()]
    out = []
    for anchor in fine:
        if anchor[0] not in anchors:
            continue
        scored = sorted((-int(np.dot(anchor[2], r[2])), r[0], r[1]) for r in fine if r is not anchor and len(r[2]) == len(anchor[2]))
        for p, positive, _ in [s for s in scored if s[2] == anchor[1]][:k]:
            there = [(n, i) for n, i, lab in scored if lab != anchor[1] and window[0] * -p <= 100 * -n <= window[1] * -p]
            out += [(anchor[0], positive, rank, i, -p, -n) for rank, (n, i) in enumerate(there[:k], 1)]
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return df.withColumns({c: F.lit("clash") for c in [*CLASH, "row", "anchor", "x", "i", "j", "top"]})


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def whole(seed, n, width, labels, size=60):
    draw = np.random.default_rng(seed)
    x = np.floor(size * draw.normal(size=(n, width)) / width**0.5)
    return [(i, int(draw.integers(labels)), v) for i, v in enumerate(x.tolist())]


@pytest.mark.parametrize("quota, block, anchors", [(2048, 4096, 512), (40, 64, 7)])
def test_mined_rows_equal_brute_force(spark, monkeypatch, quota, block, anchors):
    for name, value in (("QUOTA", quota), ("ROW_BLOCK", block), ("ANCHOR_BLOCK", anchors)):
        monkeypatch.setattr(module, name, value)
    rows = whole(1, 900, 16, 4)
    rows += [(2000 + i, i % 2, rows[0][2]) for i in range(150)]  # one vector, in two labels, with ties throughout
    rows += [(3000, 77, rows[5][2]), (3030, 77, rows[6][2])]  # a label of two rows
    want = brute(rows, set(range(0, 4000, 30)))
    assert len(want) > 300
    df = table(spark, rows)
    assert got(hard_negatives(df, F.col("vec_id") % 30 == 0)) == want


def test_odd_rows(spark):
    nan = float("nan")
    rows = [
        (0, 1, [4.0, 2.0]), (1, 1, [4.0, 2.0]), (2, 2, [4.0, 1.0]), (3, 2, [4.0, 2.0]), (4, None, [4.0, 2.0]), (5, 2, None), (6, 2, []), (7, 2, [nan, 1.0]),
        (8, 2, [4.0, None]), (9, 1, [0.0, 0.0]), (10, 2, [0.0, 0.0]), (11, 1, [-4.0, 0.0]), (None, 2, [4.0, 2.0]), (0, 1, [4.0, 2.0]), (0, 2, [5.0, 0.0]),
        (20, 1, [3.0]), (30, 1, [2.0]), (31, 2, [2.0]), (40, 1, [1.0, 1.0, 1.0]), (50, 1, [1e6, 1.0, 0.0, 0.0]), (51, 1, [1e6, 1.0, 0.0, 0.0]), (52, 0, [1e6, 0.0, 0.0, 0.0]),
    ]
    df = table(spark, rows)
    every = set(range(100))
    assert got(hard_negatives(df, F.lit(True))) == brute(rows, every)
    assert got(hard_negatives(df, F.col("vec_id") < 0)) == []
    assert got(hard_negatives(df.limit(0), F.lit(True))) == []
    assert got(hard_negatives(df, F.lit(True), 2, 1, (0, 150))) != []


def test_query_reads_labels_and_components_as_told(spark):
    rows = []
    for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect():
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        rows.append((r["vec_id"], label, np.floor(256 * np.array(r["embedding"], float)).tolist()))
    want = brute(rows, {i for i, _, _ in rows if i % 100 == 0})
    assert want and got(op11_hard_negatives(spark, FOLDER)) == want


def book(seed, n=400, width=10, codes=7):
    x = np.array([r[2] for r in whole(seed, n, width, 3)])
    made = Book(x, codes)
    (i, far_i), (j, far_j) = made.codes(x)
    for h, (c, far) in enumerate(((i, far_i), (j, far_j))):
        np.maximum.at(made.radii[h], c, far)
    np.add.at(made.rows, (i, j), 1)
    return made, x, i, j


def test_cells_come_in_order_of_bounds_that_hold():
    made, x, i, j = book(4)
    for anchor in x[:20]:
        one, two = made.bounds(anchor)
        order = list(cells_in_order([one, two]))
        assert [b for b, _, _ in order] == sorted((a + b for a in one for b in two), reverse=True)
        assert {(p, q) for _, p, q in order} == {(p, q) for p in range(len(one)) for q in range(len(two))}
        assert (x @ anchor <= one[i] + two[j]).all()


def test_a_walk_stops_where_nothing_can_matter():
    made, x, *_ = book(5)
    made.radii = [r * 0 for r in made.radii]
    every, at, done = _next_cells(made, x[0], 0, None, None)
    assert done and at == made.rows.size and sum(map(len, every.values())) == (made.rows > 0).sum()
    best = max(made.bounds(x[0])[0]) + max(made.bounds(x[0])[1])
    few, _, done = _next_cells(made, x[0], 0, best - 1e-6, None)
    assert done and sum(map(len, few.values())) <= 1
    some, at, done = _next_cells(made, x[0], 0, None, 30)
    rest, _, end = _next_cells(made, x[0], at, None, None)
    assert not done and end
    cells = [(i, j) for part in (some, rest) for i, js in part.items() for j in js]
    assert len(cells) == len(set(cells)) == (made.rows > 0).sum()
