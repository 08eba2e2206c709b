"""The stored vector index, ranking by comparison, and snapshot digests, against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import digests as D
from recordloom.operators import match as M
from recordloom.operators import reconcile as R
from recordloom.operators import vector_index as V
from recordloom.operators.tournament import top_k_by_comparison
from recordloom.operators.vector_index import read_vector_index, write_vector_index


def clustered(n, width=12, groups=20, spread=0.1, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, width))
    x = centres[draw.integers(0, groups, n)] + spread * draw.normal(size=(n, width))
    return [v.astype(np.float32).tolist() for v in x]


def hits(df):
    return sorted((r["uid"], r["rank"], r["rid"], r["score"]) for r in df.collect())


def table(spark, vectors, name, kind="long"):
    rows = [(i if kind == "long" else f"k{i:05}", v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} {kind}, v array<float>")


@pytest.mark.parametrize("kind, max_units", [("long", 100), ("string", 5)])
def test_index_search_equals_a_full_scan(spark, tmp_path, kind, max_units):
    vectors = clustered(1_200)
    vectors[100:400] = [vectors[0]] * 300  # one vector holds a quarter of the rows: ties by key
    records, units = table(spark, [*vectors, None, [], [0.0] * 12], "rid", kind), table(spark, clustered(12, seed=2) + [vectors[0], vectors[7]], "uid", kind)
    write_vector_index(records, "rid", "v", str(tmp_path / "index"), clusters=25)
    index = read_vector_index(spark, str(tmp_path / "index"))
    for k in (1, 40, 5_000):
        got = hits(index.search(units, "uid", "v", k, max_units))
        want = hits(M.search(records.filter("size(v) > 0").filter(F.exists("v", lambda x: x != 0)), units, "rid", "uid", "v", k))
        assert got == want
    assert index.search(units.limit(0), "uid", "v").count() == 0


def test_index_search_reads_few_partitions(spark, tmp_path, monkeypatch):
    records, units = table(spark, clustered(2_000, spread=0.02), "rid"), table(spark, clustered(3, spread=0.02, seed=1), "uid")
    index = write_vector_index(records, "rid", "v", str(tmp_path / "index"), clusters=30)
    bounds = index.bounds(M._unit_rows(np.array([r["v"] for r in units.collect()])))
    few = index.clusters((bounds > 0.99).any(0))
    few.collect()
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert "PartitionFilters: [cluster" in scan.toString() and scan.metrics().apply("numPartitions").value() <= 6
    # what the search itself opens, in both rounds
    opened, clusters = [], type(index).clusters
    monkeypatch.setattr(type(index), "clusters", lambda self, wanted: opened.append(int(wanted.sum())) or clusters(self, wanted))
    assert hits(index.search(units, "uid", "v", 20)) == hits(M.search(records, units, "rid", "uid", "v", 20))
    assert sum(opened) <= 8


def test_bounds_hold(spark, tmp_path):
    records = table(spark, clustered(500, spread=0.5), "rid")
    index = write_vector_index(records, "rid", "v", str(tmp_path / "index"))
    units = M._unit_rows(np.array(clustered(40, seed=3)))
    bounds = index.bounds(units)
    for r in index.rows.collect():
        assert (units @ np.array(r["v"]) <= bounds[:, r["cluster"]] + 1e-9).all()


def test_an_empty_index(spark, tmp_path):
    index = write_vector_index(table(spark, [[0.0, 0.0]], "rid"), "rid", "v", str(tmp_path / "index"))
    assert index.search(table(spark, [[1.0, 0.0]], "uid"), "uid", "v").count() == 0


def test_cascade_over_an_index_is_the_cascade(spark, tmp_path):
    records = spark.createDataFrame([(i, f"word{i % 17} word{i % 5} other{i % 3}") for i in range(300)], "rid long, t string")
    units = spark.createDataFrame([(i, f"word{i} word{i + 3} other1") for i in range(6)], "uid long, s string")
    index = write_vector_index(M.vectorise(records, "t"), "rid", "vector", str(tmp_path / "index"))
    plain = M.cascade(records, units, "rid", "uid", "t", "s", 30, 10)
    assert sorted(M.cascade(records, units, "rid", "uid", "t", "s", 30, 10, index=index).collect()) == sorted(plain.collect())


def candidates(spark, sizes, values=60):
    draw = np.random.default_rng(4)
    rows = [(u, i, int(draw.integers(values)), "x") for u, n in sizes.items() for i in draw.permutation(n).tolist()]
    return spark.createDataFrame(rows, "u string, i long, v int, s string").repartition(5), rows


def ranks(df):
    return sorted((r["u"], r["rank"], r["i"]) for r in df.collect())


@pytest.mark.parametrize("k, pivots", [(50, 4), (7, 1), (1, 9)])
def test_comparisons_give_the_head_of_a_sort(spark, k, pivots):
    sizes = {"a": 1, "b": 2, "c": 40, "hot": 900}
    df, rows = candidates(spark, sizes)
    got = top_k_by_comparison(df, "i", "u", "v", "s", k, lambda a, b, s: a - b, pivots)
    want = []
    for u in sizes:
        order = sorted((-v, i) for x, i, v, _ in rows if x == u)
        want += [(u, at, i) for at, (_, i) in enumerate(order[:k], 1)]
    assert ranks(got) == sorted(want)
    compared = {r["u"]: r["compared"] for r in got.collect()}
    assert compared["a"] == 0 and compared["b"] >= 1
    assert compared["hot"] < 900 * (pivots + 1) * 8 < 900 * 899  # far from every pair


def test_a_judge_in_arrow_batches(spark):
    df, rows = candidates(spark, {"a": 30, "b": 12})

    @F.pandas_udf("double")
    def longer(one, other, statement):
        return (one - other).astype(float)

    got = top_k_by_comparison(df.unionAll(spark.createDataFrame([(None, 1, 1, "x"), ("a", None, 1, "x")], df.schema)), "i", "u", "v", "s", 5, longer)
    assert ranks(got) == ranks(top_k_by_comparison(df, "i", "u", "v", "s", 5, lambda a, b, s: a - b))
    # who can't decide leaves it to the keys
    undecided = ranks(top_k_by_comparison(df, "i", "u", "v", "s", 5, lambda a, b, s: F.lit(None)))
    assert undecided == [(u, n + 1, n) for u in "ab" for n in range(5)]
    assert top_k_by_comparison(df.limit(0), "i", "u", "v", "s").count() == 0


def catalogue(spark, changes=()):
    rows = {i: (i, f"title {i % 7}", None if i % 5 else f"/{i}") for i in range(3_000)}
    rows.update({i: r for i, r in changes if r})
    for i, r in changes:
        if r is None:
            del rows[i]
    return spark.createDataFrame(list(rows.values()), "id long, title string, url string")


def test_changed_rows_equal_the_full_diff(spark):
    changes = [(5, None), (6, (6, "new", None)), (7, (7, "title 0", "/x")), (9_000, (9_000, "added", None)), (10, (10, None, "title 3"))]
    old, new = catalogue(spark), catalogue(spark, changes)
    got = D.changed_rows(old, new, "id", ["title", "url"])
    full = R.snapshot_diff(old, new, "id", compare=["title", "url"])
    assert got.columns == full.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, full.filter("change <> 'common'").collect()))
    counts = D.change_counts(got, D.snapshot_digests(old, "id", ["title", "url"]))
    assert sorted(counts.collect()) == sorted(full.groupBy("change").count().collect())
    assert D.changed_rows(old.limit(0), new.limit(0), "id", ["title"]).count() == 0
    assert D.changed_rows(old.limit(0), new, "id", ["title"]).count() == new.count()


def test_one_changed_row_joins_one_bucket(spark):
    old, new = catalogue(spark), catalogue(spark, [(44, (44, "other", None))]).repartition(7)
    buckets = D.differing(*[D.snapshot_digests(df, "id", ["title", "url"]) for df in (old, new)])
    assert buckets.count() == 1
    assert D.only_buckets(new, "id", buckets).count() == buckets.first()["new_n"] < 20
    same = D.differing(*[D.snapshot_digests(df, "id", ["title", "url"]) for df in (old, old.repartition(3))])
    assert same.count() == 0
    # a value that moves to the next column changes a digest
    a, b = (spark.createDataFrame([(1, *v)], "id long, title string, url string") for v in (("x", None), (None, "x")))
    assert D.changed_rows(a, b, "id", ["title", "url"]).count() == 1


def test_batches_and_repeated_keys_go_by_their_first_row(spark):
    old = catalogue(spark).withColumn("pos", F.col("id")).unionAll(catalogue(spark).limit(50).select("id", F.lit("late").alias("title"), "url", (F.col("id") + 10_000).alias("pos")))
    new = catalogue(spark, [(3, (3, "new", None))]).withColumn("pos", F.col("id"))
    got = D.changed_rows(old, new, "id", ["title"], ["pos"])
    assert [(r["id"], r["change"]) for r in got.collect()] == [(3, "changed")]


def test_centres_are_fitted_without_ordering_vectors(spark, tmp_path, monkeypatch):
    df = table(spark, clustered(300), "rid").repartition(6)
    smallest = sorted(r[0] for r in df.select(F.xxhash64("rid")).collect())[:40]
    plans, collect = [], type(df).collect
    monkeypatch.setattr(V, "SAMPLE", 40)
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    index = V.write_vector_index(df, "rid", "v", str(tmp_path / "i"))
    assert plans and not any(re.search(r"TakeOrderedAndProject\(.*\bv#", p) for p in plans)
    assert sorted(r[0] for r in V._sample(df, "rid").select(F.xxhash64("rid")).collect()) == smallest
    assert index.counts.sum() == 300 and V.write_vector_index(df.limit(0), "rid", "v", str(tmp_path / "e")).counts.sum() == 0
