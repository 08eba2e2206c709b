"""What the join of near vectors writes, where equal vectors live, and pairs at the threshold."""

import os
from pathlib import Path

import numpy as np
import pytest

from recordloom.llm import subspace_dedup
from recordloom.llm.subspace_dedup import Space, _true, cosines, near_vectors, unit
from recordloom.llm.vectors import squared_distances
from recordloom.session import work_dir
from tests.llm.test_vectors import brute_near, clustered, found, table


def test_a_vector_is_written_once_however_many_cells_it_visits(spark, monkeypatch):
    width, rows = 32, 2_000
    monkeypatch.setattr(subspace_dedup, "CELL", 50)
    x = np.random.default_rng(5).normal(size=(rows, width)).astype(np.float32)
    df = table(spark, list(enumerate(x.tolist())))
    folder = Path(os.path.dirname(work_dir(spark, "probe")))
    written = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = written()
    assert found(near_vectors(df)) == brute_near(list(enumerate(x.tolist())), 0.9)
    assert written() - before < 2 * rows * width * 4


def test_chunks_of_cells_beyond_the_range_do_not_meet(spark, monkeypatch):
    kept = {}

    def keep(df, name, write=subspace_dedup.keep):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(subspace_dedup, "keep", keep)
    monkeypatch.setattr(subspace_dedup, "CELL", 100)
    draw = np.random.default_rng(6)
    x = np.repeat(np.eye(4, 20), 100, axis=0) + 0.02 * draw.normal(size=(400, 20))
    rows = list(enumerate(x.astype(np.float32).tolist()))
    assert found(near_vectors(table(spark, rows))) == brute_near(rows, 0.9)
    chunks = kept["subspace-chunks"].collect()
    groups = {r["cell"]: {i // 100 for i in r["member_id"]} for r in chunks}
    assert len(groups) > 1
    assert all(groups[r["cell"]] & groups[c] for r in chunks for c in r["visits"] if c in groups)


@pytest.mark.parametrize("part", [40, 100_000])
def test_repeated_rows_and_hot_vectors_in_several_files(spark, monkeypatch, part):
    width = 16
    monkeypatch.setattr(subspace_dedup, "CELL", 60)
    monkeypatch.setattr(subspace_dedup, "PART_BYTES", part * 8 * width)
    monkeypatch.setattr(subspace_dedup, "CHUNK_BYTES", 32 * 4 * width)
    rows = clustered(1, width, 400, 0.3)
    rows += [(1000 + i, rows[3][1]) for i in range(300)]
    got = found(near_vectors(table(spark, rows + rows[::3]).repartition(7)))
    assert got == brute_near(rows, 0.9)
    assert got[3][0] >= 300


def test_pairs_at_the_threshold_are_decided_in_double_precision(spark):
    draw = np.random.default_rng(8)
    a = unit(draw.normal(size=(120, 24)))
    b = draw.normal(size=a.shape)
    b = unit(b - (a * b).sum(1)[:, None] * a)
    cosine = 0.9 + draw.choice([-1, 1], 120) * 10.0 ** -draw.integers(5, 14, 120)
    b = cosine[:, None] * a + np.sqrt(1 - cosine**2)[:, None] * b
    want = cosines(a, b) >= 0.9
    assert 20 < want.sum() < 100
    rows = [(i, v) for i, v in enumerate([*a.tolist(), *b.tolist()])]
    got = found(near_vectors(table(spark, rows, "double")))
    assert [got[i][0] for i in range(120)] == want.astype(int).tolist()


def test_ids_of_any_ordered_kind(spark):
    rows = clustered(2, 8, 60, 0.2)
    df = table(spark, rows).selectExpr("lpad(vec_id, 4, '0') as vec_id", "embedding")
    want = {f"{i:04d}": (n, f"{root:04d}") for i, (n, root) in brute_near(rows, 0.9).items()}
    assert found(near_vectors(df)) == want


def test_equal_vectors_live_in_one_cell_whatever_is_beside_them():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(200, 24))
    space = Space(x, 0.9, 2, 24)
    one = space.centres[0][0]
    space.centres[0] = np.array([one, -one])
    turned = draw.normal(size=(900, 24))
    turned -= (turned @ one)[:, None] * one / (one @ one)  # on the border between both, but for rounding
    units = unit(turned @ space.turn.T)

    def homes(rows):
        return space.homes(rows, squared_distances(rows @ space.turn, space.centres[0]), 0)

    want = homes(units)
    assert 0 < want.sum() < len(want)
    assert np.array_equal(want[::-1], homes(units[::-1].copy()))
    assert np.array_equal(want, np.concatenate([homes(units[a : a + 7]) for a in range(0, len(units), 7)]))


@pytest.mark.parametrize("n", [1, 8, 63, 64, 65, 1000])
def test_true(n):
    draw = np.random.default_rng(n)
    for share in (0, 0.02, 0.5, 1):
        flags = np.append(draw.random(n) < share, np.ones(64, bool))
        assert np.array_equal(_true(flags, n), np.flatnonzero(flags[:n]))
