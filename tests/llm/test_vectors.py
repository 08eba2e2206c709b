"""Near copies among vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import subspace_dedup
from recordloom.llm.subspace_dedup import Space, near_vectors
from recordloom.llm.vectors import centres_of
from tests.llm.tables import CLASH


def fine(vector):
    return bool(vector) and None not in vector and bool(np.isfinite(vector).all()) and any(vector)


def brute_near(rows, similarity):
    """vec_id to (n_links, component_id), for rows with unique ids."""
    ids = [i for i, _ in rows]
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    n = dict.fromkeys(ids, 0)
    by = {}
    for i, v in rows:
        if i is not None and fine(v):
            by.setdefault(len(v), []).append((i, v))
    for same in by.values():
        x = np.array([v for _, v in same], float)
        x /= np.abs(x).max(1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in np.argwhere(np.triu(x @ x.T >= similarity, 1)):
            a, b = same[a][0], same[b][0]
            n[a], n[b] = n[a] + 1, n[b] + 1
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (n[i], root(i)) for i in ids}


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit("clash") for c in [*CLASH, "cell", "spot", "class"]})


def found(df):
    rows = df.collect()
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    assert len({r["vec_id"] for r in rows}) == len(rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}


def clustered(seed, width, n, spread):
    """Random vectors, some of them in groups whose members lie on both sides of the threshold."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, width))
    x[n // 2 :] = x[draw.integers(0, n // 20, n - n // 2)] + spread * draw.normal(size=(n - n // 2, width))
    x *= np.exp(draw.normal(size=n))[:, None]
    return [(int(i), v) for i, v in enumerate(x.astype(np.float32).tolist())]


@pytest.mark.parametrize("width, cell, part", [(64, 4096, 16384), (64, 40, 64), (13, 60, 100), (3, 50, 90)])
def test_links_equal_brute_force(spark, monkeypatch, width, cell, part):
    monkeypatch.setattr(subspace_dedup, "CELL", cell)
    monkeypatch.setattr(subspace_dedup, "PART_BYTES", part * 8 * width)
    monkeypatch.setattr(subspace_dedup, "CHUNK_BYTES", part * 2 * width)
    rows = clustered(width, width, 600, 0.33)
    rows += [(1000 + i, rows[i % 7][1]) for i in range(90)]  # equal vectors
    want = brute_near(rows, 0.9)
    assert sum(n for n, _ in want.values()) > 500
    assert found(near_vectors(table(spark, rows))) == want


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(subspace_dedup, "CELL", 100)
    monkeypatch.setattr(subspace_dedup, "PART_BYTES", 150 * 8 * 16)
    monkeypatch.setattr(subspace_dedup, "CHUNK_BYTES", 40 * 4 * 16)
    monkeypatch.setattr(subspace_dedup, "TILE", (16, 64))
    draw = np.random.default_rng(3)
    x = draw.normal(size=(900, 16))
    x[::3] = x[0] + 0.05 * draw.normal(size=(300, 16))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    want = brute_near(rows, 0.9)
    assert want[0] == (299, 0)
    assert found(near_vectors(table(spark, rows))) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1e300, 1e290]), (4, [-1.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, None]),
        (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [5e-300, 0.0, 0.0]), (13, [1.0] * 40), (14, [-0.0, 1.0]), (15, [0.0, 1.0]),
        (16, [3.0]), (17, [2.0]), (18, [-2.0]),
    ]
    df = table(spark, [*rows, rows[0], (None, None)], "double")
    got = found(near_vectors(df))
    assert got.pop(None) == (0, None)
    assert got == brute_near(rows, 0.9)
    assert got[3] == (2, 1) and got[12] == (1, 11) and got[17] == (1, 16) and got[13] == (0, 13)
    assert near_vectors(df.limit(0)).count() == 0
    assert found(near_vectors(table(spark, rows, "double"), similarity=0.5)) == brute_near(rows, 0.5)


def test_every_close_pair_meets_in_its_first_block():
    """The pigeonhole: whoever is within the budget of a block shares a cell there."""
    draw = np.random.default_rng(9)
    x = draw.normal(size=(500, 24))
    x[250:] = x[:250] + 0.4 * draw.normal(size=(250, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    space = Space(x, 0.9, 12)
    first = space.first_block(x[:250] - x[250:])
    close = (x[:250] * x[250:]).sum(1) >= 0.9
    assert close.sum() > 50 and (first[close] >= 0).all()
    cells = {c: dict(zip(at.tolist(), home.tolist())) for c, at, home in space.cells(x)}
    for i in np.flatnonzero(first >= 0):
        together = [m for c, m in cells.items() if c // subspace_dedup.MOST_CELLS == first[i] and i in m and i + 250 in m]
        assert any(m[i] or m[i + 250] for m in together)


def test_centres_of_equal_rows():
    assert len(centres_of(np.ones((10, 4)), 5)) == 1
