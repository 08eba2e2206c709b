"""Tables and postings that are stored, and read in part."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recordloom.operators import quality as Q
from recordloom.operators import reconcile as R
from recordloom.operators.extract import detail_pages, session_details
from recordloom.operators.stored import StoredTable, bucket_of
from recordloom.operators.text_index import write_text_index


def files(path):
    return {p.relative_to(path).as_posix(): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def base(spark, n=400):
    return spark.createDataFrame([(f"S{i}", f"title {i}", i % 7) for i in range(n)] + [(None, "no key", 0)], "id string, title string, room int")


def rows(df):
    return sorted(map(str, df.collect()))


def test_an_upsert_writes_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    stored = StoredTable(spark, path, "id", buckets=16).create(base(spark))
    before = files(path)
    updates = spark.createDataFrame([("S3", "new", 1), ("S3", "newer", 2), ("X", "added", 1)], "id string, title string, at int")
    want = R.upsert(base(spark).withColumn("at", F.lit(None).cast("int")), updates.withColumn("room", F.lit(None).cast("int")), "id", ["at"])
    written = stored.upsert(updates, ["at"])
    assert rows(stored.read()) == rows(want.select("id", "title", "room"))
    assert 0 < len(written) <= 2
    after = files(path)
    same = {f for f in before if not any(f.startswith(f"bucket={b}/") for b in written)}
    assert same and {f: before[f] for f in same} == {f: after.get(f) for f in same}
    once = rows(stored.read())
    stored.upsert(updates, ["at"])  # a run that is repeated
    assert rows(stored.read()) == once
    assert stored.upsert(updates.limit(0), ["at"]) == [] and rows(stored.read()) == once


def test_only_touched_buckets_are_read(spark, tmp_path):
    stored = StoredTable(spark, str(tmp_path / "t"), "id", buckets=16).create(base(spark))
    few = stored.only(stored.touched(base(spark).filter("id = 'S9'")))
    few.collect()
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numPartitions").value() == 1
    assert stored.read().filter("id is null").count() == 1
    assert few.select(bucket_of("id", 16)).distinct().count() == 1


def test_rows_are_replaced_in_their_buckets(spark, tmp_path):
    stored = StoredTable(spark, str(tmp_path / "t"), "id", buckets=16).create(base(spark))
    fresh = spark.createDataFrame([("S5", "S5", "fresh", 99), ("S6", "other", "wrong page", 99)], "id string, found string, title string, room int")
    want = rows(R.replace_rows(base(spark), fresh, "id", ["room"], "found"))
    assert len(stored.replace(fresh, ["room"], "found")) <= 2
    assert rows(stored.read()) == want


TEXTS = ["Deep Learning for Graphs", "deep sea", "GRAPHS and deep", None, "", "ab", "a%b_c 'x' é", "ÉCOLE d'été", "graph\ns", "x" * 5_000 + "needle" + "y" * 5_000]


@pytest.mark.parametrize("needle", ["deep", "GRAPHS", "graphs and", "école", "%b_", "'x'", "needle", "xxxy", "nothing here", "ab", "", "d", "h\ns", "été"])
def test_index_search_equals_the_scan(spark, tmp_path, needle):
    df = spark.createDataFrame([(i, t, TEXTS[-1 - i] if i % 2 else None) for i, t in enumerate(TEXTS)], "id long, title string, keywords string")
    index = write_text_index(df, "id", ["title", "keywords"], str(tmp_path / "i"))
    assert rows(index.search(df, needle)) == rows(Q.search(df, needle, ["title", "keywords"]))


def test_trigrams_of_two_fields_do_not_meet(spark, tmp_path):
    df = spark.createDataFrame([(1, "abcd", "bcde"), (2, "abcde", None)], "id long, a string, b string")
    index = write_text_index(df, "id", ["a", "b"], str(tmp_path / "i"))
    assert [r["id"] for r in index.candidates("abcde").collect()] == [2]


def test_pages_with_text_keys(spark):
    html = "<html><h1>Talk [S12]</h1><p>Topic: Data</p><h2>Group</h2><h5>Room</h5></html>"
    pages = spark.createDataFrame([("p1", html, "invited-talk"), ("p2", None, "group")], "page_id string, html string, kind string")
    assert {r["page_id"] for r in session_details(pages).collect()} == {"p1", "p2"}
    assert {r["page_id"] for r in detail_pages(pages).collect()} == {"p1", "p2"}
