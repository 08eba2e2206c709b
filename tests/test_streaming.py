"""Incremental runs over many files, with replays and failures."""

from pyspark.sql import functions as F

from recordloom.streaming import incremental as I


def _files(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "id string, v int").coalesce(1).write.mode("append").parquet(path)


def _process(batch):
    return batch.withColumn("error", F.when(F.col("v") < 0, "bad"))


def test_resume_skips_done_and_retries_failed(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    _files(spark, src, [[("a", 1), ("b", -1), ("a", 9)]])
    I.run_incremental(I.read_stream(spark, src, 1), out, chk, "id", ["v"], _process).awaitTermination()
    assert {(r.id, r.v) for r in I.results(spark, out, "id").collect()} == {("a", 1)}
    assert {(r.id, r.error) for r in I.failed(spark, out, "id").collect()} == {("b", "bad")}
    _files(spark, src, [[("a", 5), ("b", 7)], [("c", 3)]])
    I.run_incremental(I.read_stream(spark, src, 1), out, chk, "id", ["v"], _process).awaitTermination()
    assert {(r.id, r.v) for r in I.results(spark, out, "id").collect()} == {("a", 1), ("b", 7), ("c", 3)}
    assert I.failed(spark, out, "id").count() == 0


def test_retry_failed(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    _files(spark, src, [[("a", -1), ("b", 2)]])
    I.run_incremental(I.read_stream(spark, src), out, chk, "id", ["v"], _process).awaitTermination()
    I.retry_failed(spark, out, "id", _process)
    assert {r.id for r in I.failed(spark, out, "id").collect()} == {"a"}
    I.retry_failed(spark, out, "id", lambda d: d.withColumn("error", F.lit("")))
    assert I.failed(spark, out, "id").count() == 0
    assert {(r.id, r.v) for r in I.results(spark, out, "id").collect()} == {("a", -1), ("b", 2)}


def test_seen_ids_over_loads(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    for part in ([("a", 5), ("b", 2)], [("a", 1)], [("a", 9), ("c", 4)]):
        _files(spark, src, [part])
        I.track_ids(I.read_stream(spark, src, 1), "id", "v", out, chk).awaitTermination()
    got = {(r.id, r.first_seen, r.sightings) for r in I.tracked_ids(spark, out, "id").collect()}
    assert got == {("a", 1, 3), ("b", 2, 1), ("c", 4, 1)}


def test_new_ids_over_loads(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    for part in ([("a", i) for i in range(50)] + [("b", 2)], [("a", 1), ("c", 3)], [("c", 9), ("b", 4)]):
        _files(spark, src, [part])
        once = I.new_ids(I.read_stream(spark, src, 1), "id", ["v"], salts=4)
        writer = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk)
        writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_a_stream_reads_its_own_folder_or_file_only(spark, tmp_path):
    for name in ("events", "events_old"):
        _files(spark, str(tmp_path / name), [[(name, 1)]])

    def ids(path, n):
        out, chk = str(tmp_path / f"out{n}"), str(tmp_path / f"chk{n}")
        writer = I.read_stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", chk)
        writer.trigger(availableNow=True).start().awaitTermination()
        return {r.id for r in spark.read.parquet(out).collect()}

    assert ids(str(tmp_path / "events"), 1) == {"events"}
    spark.createDataFrame([("x", 1)], "id string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    file = sorted(p for p in (tmp_path / "events").iterdir() if p.suffix == ".parquet")[0]
    assert len(ids(str(file), 2)) == 1


def test_nothing_before_the_first_batch(spark, tmp_path):
    out = str(tmp_path / "none")
    assert I.results(spark, out, "id").count() == 0 and I.failed(spark, out, "id").count() == 0
    I.retry_failed(spark, out, "id", _process)


def test_a_newer_stream_failure_outranks_an_older_retry(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    _files(spark, src, [[("a", -1)]])
    I.run_incremental(I.read_stream(spark, src), out, chk, "id", ["v"], _process).awaitTermination()
    I.retry_failed(spark, out, "id", lambda d: d.withColumn("error", F.lit("retry")))
    _files(spark, src, [[("a", -2)]])
    newest = lambda b: b.withColumn("error", F.lit("newest"))
    I.run_incremental(I.read_stream(spark, src), out, chk, "id", ["v"], newest).awaitTermination()
    assert {(r.id, r.error) for r in I.failed(spark, out, "id").collect()} == {("a", "newest")}
