"""What is kept from run to run: bitmaps of counts, generated texts, the state of keys."""

import pytest
from pyspark.sql import functions as F

from recordloom.operators import quality as Q
from recordloom.operators.bitmaps import BatchCounts
from recordloom.operators.remembered import Remembered
from recordloom.streaming import incremental as I


def checks():
    return {"good": F.col("v") > 3, "odd": F.col("v") % 2 == 1}


def records(spark, ids):
    return spark.createDataFrame([(i, None if i % 11 == 0 else i % 7) for i in ids], "id long, v int")


def test_merged_counts_are_the_direct_ones(spark, tmp_path):
    ids = [*range(-40, 300), *range(32_700, 32_900), 10**9, 2**40]
    parts = [ids[:200], ids[150:400], [*ids[390:], 5, 5, 5]]  # they overlap, and repeat rows
    counts = BatchCounts(spark, str(tmp_path / "b"))
    for n, part in enumerate(parts):
        counts.add(f"p{n}", records(spark, part), "id", checks())
    want = Q.coverage(records(spark, ids), checks()).first().asDict()
    assert counts.coverage("good", "odd").first().asDict() == want
    assert {r["set"]: r["n"] for r in counts.counts().collect()} == want
    counts.add("p1", records(spark, parts[1]), "id", checks())  # a batch that is run again
    assert counts.coverage("good", "odd").first().asDict() == want
    wanted, done = (records(spark, ids).filter(checks()[c]) for c in ("good", "odd"))
    assert counts.completeness("good", "odd").first().asDict() == Q.completeness(wanted, done, "id").first().asDict()


def test_merged_counts_of_nothing(spark, tmp_path):
    counts = BatchCounts(spark, str(tmp_path / "b"))
    counts.add("none", records(spark, []), "id", checks())
    counts.add("null", spark.createDataFrame([(None, 5)], "id long, v int"), "id", checks())
    assert counts.coverage("good").first().asDict() == {"total": 0, "good": 0}
    assert counts.completeness("good", "odd").first().complete
    with pytest.raises(ValueError):
        counts.add("x", records(spark, []), "id", {"total": F.lit(True)})


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id int, _record string, _unit string")


def test_texts_are_made_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(record, unit):
        calls.add(1)
        return None if record == "fails" else f"{record}|{unit}"

    rows = [(1, "a", "u"), (2, "a", "u"), (3, "b", "u"), (4, "fails", "u"), (5, None, "u"), (6, "", "u"), (7, "au", "")]
    notes = Remembered(spark, str(tmp_path / "n"))
    got = {r.id: r.why for r in notes.annotate(pairs(spark, rows), "why", "why", generator=model).collect()}
    assert got == {1: "a|u", 2: "a|u", 3: "b|u", 4: None, 5: "None|u", 6: "|u", 7: "au|"}
    assert calls.value == 6
    again = {r.id: r.why for r in notes.annotate(pairs(spark, rows + [(8, "c", "u")]), "why", "why", generator=model).collect()}
    assert again == got | {8: "c|u"}
    assert calls.value == 8  # the one that failed, and the new one
    notes.annotate(pairs(spark, rows[:1]), "another instruction", "why", generator=model).collect()
    assert calls.value == 9


def test_a_killed_run_resumes(spark, tmp_path):
    rows = [(i, f"r{i}", "u") for i in range(40)]
    notes = Remembered(spark, str(tmp_path / "n"))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(record, unit):
        calls.add(1)
        return record

    broken = F.udf(lambda record, unit: 1 / 0 if record == "r7" else record, "string")
    with pytest.raises(Exception):
        notes.annotate(pairs(spark, rows), "why", "why", generator=broken).collect()
    stored = notes.texts().count()
    assert stored < 40
    got = notes.annotate(pairs(spark, rows), "why", "why", generator=model)
    assert {(r.id, r.why) for r in got.collect()} == {(i, f"r{i}") for i in range(40)}
    assert calls.value == 40 - stored


def process(batch):
    return batch.withColumn("error", F.when(F.col("v") < 0, "bad"))


def write(spark, path, *parts):
    for rows in parts:
        spark.createDataFrame(rows, "id string, v int").coalesce(1).write.mode("append").parquet(path)


def seen(df):
    return {(r.id, r.v) for r in df.collect()}


def test_keys_known_by_state(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    run = I.KeyedRun(spark, out, "id", process, wait=0, max_tries=3)
    write(spark, src, [("a", 3), ("a", 1), ("b", -1), (None, 4)])
    run.start(I.read_stream(spark, src, 1), chk, ["v"]).awaitTermination()
    assert seen(run.results()) == {("a", 1), (None, 4)}
    assert {(r.id, r.tries) for r in run.failures().collect()} == {("b", 1)}
    write(spark, src, [("a", 0), ("c", 5), (None, 1)])
    run.start(I.read_stream(spark, src, 1), chk, ["v"]).awaitTermination()
    assert seen(run.results()) == {("a", 1), (None, 4), ("c", 5)}  # known keys are not processed again
    assert {(r.id, r.tries) for r in run.failures().collect()} == {("b", 2)}  # it was due
    last = spark.read.parquet(f"{out}/log/seq={I.STRIDE}")
    assert {r.id for r in last.collect()} == {"b", "c"}
    # a batch does not grow with what was done before it: its log holds new and due rows alone
    I.KeyedRun(spark, out, "id", lambda df: df.withColumn("error", F.lit(""))).retry()
    assert seen(run.results()) == {("a", 1), (None, 4), ("c", 5), ("b", -1)}
    assert run.failures().count() == 0


def test_failures_wait_and_are_given_up(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    write(spark, src, [("b", -1), ("ok", 1)])
    patient = I.KeyedRun(spark, out, "id", process, wait=3600)
    patient.retry()  # before the first batch there is nothing to do
    patient.start(I.read_stream(spark, src, 1), chk, ["v"]).awaitTermination()
    patient.retry()
    assert [(r.id, r.tries) for r in patient.failures().collect()] == [("b", 1)]
    due = patient._queue().first()._due
    assert 3500 < (due - spark.range(1).select(F.current_timestamp()).first()[0]).total_seconds() <= 3600


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    write(spark, src, [("a", 1), ("b", 2)])
    run = I.KeyedRun(spark, out, "id", process, wait=0)
    run.start(I.read_stream(spark, src, 1), chk, ["v"]).awaitTermination()
    write(spark, src, [("a", 7), ("c", 3)])
    fails = I.KeyedRun(spark, out, "id", lambda df: df.withColumn("error", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception):
        fails.start(I.read_stream(spark, src, 1), chk, ["v"]).awaitTermination()
    run.start(I.read_stream(spark, src, 1), chk, ["v"]).awaitTermination()
    assert seen(run.results()) == {("a", 1), ("b", 2), ("c", 3)}
