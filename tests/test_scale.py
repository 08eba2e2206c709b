"""The skew-proof building blocks against brute force, with one key holding a third of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import match as M
from recordloom.operators.dedup import distinct_list_parts, distinct_lists, text_parts, text_per_unit
from recordloom.operators.scale import (
    carry_forward,
    first_per_key,
    last_per_key,
    number_rows,
    skew_join,
    small_or_shuffled,
    top_k,
)


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(7)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(1, 50), rng.randrange(1000), rng.choice("abc")) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k int, v int, s string").repartition(5), rows


def test_first_and_last_per_key(hot):
    df, rows = hot
    want_first, want_last = {}, {}
    for r in sorted(rows, key=lambda r: r[0]):
        want_first.setdefault(r[1], r)
        want_last[r[1]] = r
    assert {r.k: tuple(r) for r in first_per_key(df, ["k"], ["id"]).collect()} == want_first
    assert {r.k: tuple(r) for r in last_per_key(df, ["k"], ["id"]).collect()} == want_last


def test_top_k_ranks_without_gaps(hot):
    df, rows = hot
    got = top_k(df, ["k"], [F.desc("v"), F.col("id")], 20, ["id"], salts=4).collect()
    want = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        want.setdefault(r[1], []).append(r[0])
    for k, ids in want.items():
        ranked = sorted((r["rank"], r["id"]) for r in got if r["k"] == k)
        assert ranked == list(enumerate(ids[:20], 1))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("salts", [1, 8])
def test_skew_join_equals_join(spark, hot, how, salts):
    df, rows = hot
    dims = spark.createDataFrame([(k, f"d{k}") for k in range(0, 40)], "k int, d string")
    got = skew_join(df, dims, ["k"], ["id"], how, salts=salts, min_rows=60, max_hot=5, max_small=0)
    want = df.join(dims, "k", how)
    key = lambda d: sorted((r.id, r.k, r.d or "") for r in d.collect())
    assert key(got) == key(want) and got.count() == want.count()


def test_skew_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(100)], "id long, k string")
    right = spark.createDataFrame([("a", 1)], "k string, x int")
    assert skew_join(left, right, ["k"], ["id"], min_rows=10, max_small=0).count() == 100
    assert skew_join(left, right, ["k"], ["id"]).count() == 100


def test_skew_join_broadcasts_a_measured_small_side(spark, hot):
    df, _ = hot
    dims = spark.createDataFrame([(k, f"d{k}") for k in range(40)], "k int, d string")
    text = skew_join(df, dims, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "approx_top_k" not in text and text.count("BroadcastHashJoin") == 1
    beyond = skew_join(df, dims, ["k"], ["id"], max_small=39)._jdf.queryExecution().executedPlan().toString()
    assert "partial_approx_top_k" in beyond


@pytest.mark.parametrize("keys", ["dense", "sparse", "clustered", "negative"])
def test_number_rows(spark, keys):
    rng = random.Random(3)
    ids = {
        "dense": list(range(5000)),
        "sparse": list({rng.randrange(-(2**62), 2**62) for _ in range(3000)}),
        "clustered": list(range(2000)) + [2**60 + i * 2**40 for i in range(1000)],
        "negative": list(range(-700, 300)),
    }[keys]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    got = {r.id: r.row_no for r in number_rows(df, "id", parts=16).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids), 1)}
    text = df.select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("id"))
    got = {r.id: r.row_no for r in number_rows(text, "id", parts=16).collect()}
    assert got == {v: i for i, v in enumerate(sorted(f"S{i}" for i in ids), 1)}


def test_one_far_key_does_not_put_all_rows_in_one_range(spark):
    from recordloom.session import work_dir

    df = spark.range(20_000).unionAll(spark.createDataFrame([(2**62,)], "id long"))
    ranged = df.repartitionByRange(16, "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert ranged < 4_000 and work_dir(spark, "x")
    got = number_rows(df, "id", parts=16).agg(F.min("row_no"), F.max("row_no"), F.countDistinct("row_no")).first()
    assert tuple(got) == (1, 20_001, 20_001)


def test_number_rows_inside_groups_and_without_keys(spark):
    rows = [("a" if i % 3 else None, i if i % 10 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(3)
    for g in ("a", None):
        mine = sorted(number_rows(df, "id", parts=5, group=["g"]).filter(F.col("g").eqNullSafe(F.lit(g))).collect(), key=lambda r: r.row_no)
        assert [r.row_no for r in mine] == list(range(1, len(mine) + 1))
        keys = [r.id for r in mine]
        nulls = keys.count(None)
        assert keys[:nulls] == [None] * nulls and keys[nulls:] == sorted(keys[nulls:])


def test_rows_of_one_key_are_numbered_once_each(spark):
    rows = [(7, i) for i in range(50)] + [(i, i) for i in range(100, 130)] + [(None, 1), (None, 1), (8, 5), (8, 5)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(4)
    got = number_rows(df, "id", parts=6).collect()
    assert sorted(r.row_no for r in got) == list(range(1, len(rows) + 1))
    assert sorted((str(r.id), r.v) for r in got) == sorted((str(i), v) for i, v in rows)
    assert [r.id for r in sorted(got, key=lambda r: r.row_no)] == [None, None, *sorted(i for i, _ in rows if i is not None)]
    again = number_rows(df.repartition(3), "id", parts=9).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_a_hot_key_is_parted_over_ranges(spark):
    df = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id", F.create_map(F.lit("a"), "id").alias("m"))
    got = number_rows(df, "k", parts=12)
    assert got.agg(F.min("row_no"), F.max("row_no"), F.countDistinct("row_no")).first()[:] == (1, 9_000, 9_000)
    ranged = df.repartitionByRange(12, F.asc_nulls_first("k"), F.xxhash64("k", "id")).groupBy(F.spark_partition_id()).count()
    assert ranged.agg(F.max("count")).first()[0] < 2_000


def test_a_plain_local_session_has_a_work_folder(monkeypatch):
    """Where the session names no folder a local one gets its own, the same each time; a cluster must name one."""
    from recordloom import session

    class Plain:
        master, applicationId = "local[2]", "app-1"
        sparkContext = property(lambda self: self)
        conf = property(lambda self: self)

        def get(self, name, default=None):
            return default

        def getCheckpointDir(self):
            return None

    plain = Plain()
    a, b = (session.work_dir(plain, "x").rsplit("/", 1) for _ in range(2))
    assert a[0] == b[0] and a[1] != b[1]
    plain.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        session.work_dir(plain, "x")


def test_carry_forward_over_segments(spark):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(1, 4), i, rng.choice(["x", "y", None, None, None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, pos long, v string").repartition(4)
    want, last = {}, {}
    for g, pos, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[pos] = last[g]
    got = carry_forward(df, ["g"], ["pos"], ["v"], F.floor(F.col("pos") / 50))
    assert {r.pos: r.v for r in got.collect()} == want


def test_distinct_lists_and_parts(hot):
    df, rows = hot
    want = {}
    for r in sorted(rows, key=lambda r: r[0]):
        if r[3] not in want.setdefault(r[1], []):
            want[r[1]].append(r[3])
    assert {r.k: r.out for r in distinct_lists(df, "k", "s", ["id"], "out").collect()} == want
    parts = distinct_list_parts(df.withColumn("x", F.col("id").cast("string")), "k", "x", "id", "out", part_size=100).collect()
    whole = {}
    for r in sorted(parts, key=lambda r: (r.k, r.part)):
        assert len(r.out) <= 100
        whole.setdefault(r.k, []).extend(r.out)
    assert whole[0] == [str(r[0]) for r in rows if r[1] == 0]


def test_text_parts_join_to_the_whole(spark):
    df = spark.createDataFrame([(1, i, "c ", f"t{i}") for i in range(25)], "u int, p int, c string, t string")
    parts = text_parts(df, "u", "p", "c", "t", part_size=10).orderBy("part").collect()
    assert len(parts) == 3
    assert "\n".join(r.unit_text for r in parts) == "\n".join(f"[c] t{i}" for i in range(25))


def test_a_unit_of_many_positions_is_one_row(spark):
    df = spark.range(12_000).select(F.lit(1).alias("u"), F.col("id").alias("p"), F.lit("c").alias("c"), F.concat(F.lit("t"), "id").alias("t"))
    rows = text_per_unit(df, "u", "p", "c", "t").collect()
    assert len(rows) == 1 and rows[0].unit_text == "\n".join(f"[c] t{i}" for i in range(12_000))


def test_broadcast_only_when_small(spark):
    df = spark.range(100)
    hinted = small_or_shuffled(df, 100)._jdf.queryExecution().analyzed().toString()
    plain = small_or_shuffled(df, 99)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in hinted and "ResolvedHint" not in plain


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 8)).astype(np.float32)
    base[200:300] = base[0]  # a group of copies: ties go by id
    records = [(i, [float(x) for x in base[i]]) for i in range(400)] + [(400, []), (401, None)]
    units = [(u, [float(x) for x in rng.normal(size=8)]) for u in range(30)]
    r = spark.createDataFrame(records, "rid long, v array<float>").repartition(6)
    return r, spark.createDataFrame(units, "uid long, v array<float>"), base, units


def _brute(base, units, k):
    want = {}
    for u, v in units:
        v = np.array(v, np.float32).astype(float)
        b = base.astype(float)
        s = np.round(b @ v / np.linalg.norm(b, axis=1) / np.linalg.norm(v), 6)
        want[u] = [int(i) for i in np.lexsort((np.arange(len(s)), -s))[:k]]
    return want


@pytest.mark.parametrize("max_units", [1000, 7])
def test_search_both_ways(vectors, max_units):
    records, units, base, raw = vectors
    got = M.search(records, units, "rid", "uid", "v", k=120, max_units=max_units).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.uid, []).append(r.rid)
    assert found == _brute(base, raw, 120)


def test_best_unit_both_ways(vectors):
    records, units, base, raw = vectors
    few = {r.rid: (r.uid, r.score) for r in M.best_unit(records, units, "rid", "uid", "v").collect()}
    many = {r.rid: (r.uid, r.score) for r in M.best_unit(records, units, "rid", "uid", "v", max_units=7).collect()}
    assert few == many and len(few) == 402 and few[400] == few[401] == (None, None)
    none = M.best_unit(records, units.limit(0), "rid", "uid", "v").collect()
    assert len(none) == 402 and {r.uid for r in none} == {None}


@pytest.mark.parametrize("max_units", [1000, 7])
def test_search_with_text_ids(vectors, max_units):
    records, units, base, raw = vectors
    r = records.withColumn("rid", F.concat(F.lit("S"), F.lpad(F.col("rid").cast("string"), 5, "0")))
    u = units.withColumn("uid", F.concat(F.lit("unit "), "uid"))
    found = {}
    for row in sorted(M.search(r, u, "rid", "uid", "v", k=120, max_units=max_units).collect(), key=lambda x: x["rank"]):
        found.setdefault(row.uid, []).append(row.rid)
    assert found == {f"unit {k}": [f"S{i:05d}" for i in v] for k, v in _brute(base, raw, 120).items()}
    plain = {f"S{x.rid:05d}": x.uid for x in M.best_unit(records, units, "rid", "uid", "v").collect()}
    named = {x.rid: x.uid for x in M.best_unit(r, units, "rid", "uid", "v", max_units=max_units).collect()}
    assert named == plain


def test_search_without_units(vectors):
    records, units, *_ = vectors
    assert M.search(records, units.limit(0), "rid", "uid", "v").count() == 0
