"""Incremental runs: process only keys not done before, retry what failed, know every id once.

Each micro-batch writes its own ``batch=N`` folder, overwriting it when Spark replays the
batch, so a lost executor or a restart neither loses nor doubles records. Nothing ever
rewrites earlier batches; readers take the newest record per key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from recordloom.functions.text import missing
from recordloom.operators.reconcile import pending
from recordloom.operators.scale import first_per_key, last_per_key

RETRY_BASE = 1_000_000_000


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A parquet table, folder or single file, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(fs_path).isFile():  # a stream takes a folder: this file's, and of it this file
        name = re.sub(r"([\\*?\[\]{}])", r"\\\1", fs_path.getName())
        return reader.option("pathGlobFilter", name).parquet(fs_path.getParent().toString())
    return reader.parquet(path)


def _log(spark: SparkSession, out: str) -> DataFrame | None:
    """What earlier batches wrote, None before the first.

    ``attempt`` is the time a record was processed, so the newest of a key is known whichever
    batch it came with.
    """
    try:
        return spark.read.option("basePath", out).parquet(out)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _write_batch(done: DataFrame, out: str, batch_id: int) -> None:
    # one write of both kinds, so that the work is done once
    status = F.when(missing(F.col("error")), "ok").otherwise("error")
    done.withColumns({"status": status, "attempt": F.current_timestamp()}).write.mode("overwrite").partitionBy("status").parquet(f"{out}/batch={batch_id}")


def run_incremental(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    key: str,
    order: Sequence[str],
    process: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Process what is available now and return the query (await it).

    ``process`` adds a text column ``error``: '' or null for rows that worked. Keys that
    worked in an earlier batch are skipped; keys that failed are tried again when they
    come again, or by ``retry_failed``.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = first_per_key(batch, [key], order)
        log = _log(spark, out)
        if log is not None:
            earlier = (F.col("batch") < batch_id) | (F.col("batch") >= RETRY_BASE)
            fresh = pending(fresh, log.filter(earlier & (F.col("status") == "ok")), key)
        _write_batch(process(fresh), out, batch_id)

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def results(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The newest good record per key; before the first batch a table of no rows, and of the key alone."""
    log = _log(spark, out)
    if log is None:
        return spark.createDataFrame([], f"`{key}` string")
    ok = log.filter("status = 'ok'").drop("status", "error")
    return last_per_key(ok, [key], ["attempt", "batch"]).drop("batch", "attempt")


def failed(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The newest failure, by time of the attempt, of every key that never worked; none before the first batch."""
    log = _log(spark, out)
    if log is None:
        return spark.createDataFrame([], f"`{key}` string, error string")
    bad = last_per_key(log.filter("status = 'error'").drop("status"), [key], ["attempt", "batch"])
    return pending(bad, log.filter("status = 'ok'"), key).drop("batch", "attempt")


def retry_failed(spark: SparkSession, out: str, key: str, process: Callable[[DataFrame], DataFrame]) -> None:
    """Process the failed records once more, as a batch of their own."""
    log = _log(spark, out)
    if log is None:
        return
    last = log.agg(F.max(F.when(F.col("batch") >= RETRY_BASE, F.col("batch")))).first()[0]
    again = failed(spark, out, key).drop("error")
    _write_batch(process(again), out, RETRY_BASE if last is None else last + 1)


# --- the same with the state of keys in the stream ---------------------------------------------

#: Tries of a failing record before it is left for good.
MAX_TRIES = 5
#: Runs outside the stream come between two of its batches, at most this many less one.
STRIDE = 1000


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole folders ``seq=N`` below ``path``, in order."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(fs_path) if f.isDirectory()]
    done = [n for n in names if n.startswith("seq=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("seq=")) for n in done)


class KeyedRun:
    """Every key once, by state in the stream, with a queue of failures that waits longer each time.

    The stream keeps, for every key, when it came first and last: a key is new if both are the time
    of this micro-batch, which Spark writes to its log, so a replay decides alike. No batch reads
    what earlier ones wrote but the queue, which holds the open failures alone. Copies of a key
    merge before the shuffle; the state is one row per key. ``process`` keeps all columns and adds
    a text ``error``, '' or null for rows that worked; keys may be null, one key like any other.

    Folders: ``log/seq=N`` holds what was processed, ``open/seq=N`` the whole queue after that. A
    failure is due again after ``wait`` seconds, then twice that, and so on, up to ``max_tries`` tries in all.
    """

    def __init__(self, spark: SparkSession, out: str, key: str, process: Callable[[DataFrame], DataFrame], wait: float = 60, max_tries: int = MAX_TRIES):
        self.spark, self.out, self.key, self.process, self.wait, self.max_tries = spark, out, key, process, wait, max_tries

    def start(self, stream: DataFrame, checkpoint: str, order: Sequence[str]) -> StreamingQuery:
        """Process what is available now; of a key's rows in a micro-batch the first by ``order``."""
        row, now = F.struct(*stream.columns), F.current_timestamp()
        timed = stream.select(F.col(self.key).alias("_key"), row.alias("_row"), F.struct(*order).alias("_order"), now.alias("_at"))
        state = timed.groupBy("_key").agg(
            F.min_by("_row", F.struct("_at", "_order")).alias("row"), F.min("_at").alias("first"), F.max("_at").alias("last")
        )

        def save(batch: DataFrame, batch_id: int) -> None:
            self._step(batch.filter(F.col("first") == F.col("last")).select("row.*"), batch_id * STRIDE)

        writer = state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    def retry(self) -> None:
        """Try the failures that are due, between two runs of the stream."""
        before = _folders(self.spark, f"{self.out}/open")
        if before:
            self._step(None, before[-1] + 1)

    def _queue(self, before: int | None = None) -> DataFrame | None:
        found = [n for n in _folders(self.spark, f"{self.out}/open") if before is None or n < before]
        return self.spark.read.parquet(f"{self.out}/open/seq={found[-1]}") if found else None

    def _step(self, fresh: DataFrame | None, seq: int) -> None:
        log, waiting = f"{self.out}/log/seq={seq}", None
        queue = self._queue(seq)
        todo = [] if fresh is None else [fresh.withColumn("_tries", F.lit(0))]
        if queue is not None:
            now = F.lit(self.spark.range(1).select(F.current_timestamp()).first()[0])
            due = (F.col("_due") <= now) & (F.col("_tries") < self.max_tries)
            todo.append(queue.filter(due).drop("_due", "error"))
            waiting = queue.filter(~due)
        rows = todo[0] if len(todo) == 1 else todo[0].unionByName(todo[1])
        columns = rows.columns
        status = F.when(missing(F.col("error")), "ok").otherwise("error")
        done = self.process(rows).withColumns({"_status": status, "_attempt": F.current_timestamp()})
        done.write.mode("overwrite").parquet(log)
        bad = self.spark.read.parquet(log).filter("_status = 'error'").withColumn("_tries", F.col("_tries") + 1)
        seconds = F.lit(float(self.wait)) * F.pow(F.lit(2.0), F.col("_tries") - 1)
        bad = bad.withColumn("_due", F.timestamp_micros(F.unix_micros("_attempt") + (seconds * 1_000_000).cast("long")))
        bad = bad.select(*columns, "error", "_due")
        if waiting is not None:
            bad = waiting.unionByName(bad)
        bad.write.mode("overwrite").parquet(f"{self.out}/open/seq={seq}")

    def results(self) -> DataFrame:
        """The record of every key that worked. Needs a run before it."""
        log = self.spark.read.option("basePath", f"{self.out}/log").parquet(f"{self.out}/log")
        ok = log.filter("_status = 'ok'")
        return last_per_key(ok, [self.key], ["_attempt", "seq"]).drop("error", "seq", "_tries", "_status", "_attempt")

    def failures(self) -> DataFrame:
        """Open failures with the number of tries. Needs a run before it."""
        return self._queue().withColumnRenamed("_tries", "tries").drop("_due")


def track_ids(stream: DataFrame, key: str, order: str, out: str, checkpoint: str) -> StreamingQuery:
    """Every id once, with its first place and how often it was seen.

    A streaming aggregate: copies of an id merge inside each task before the shuffle, and
    the state holds one small row per id.
    """
    seen = stream.groupBy(key).agg(F.min(order).alias("first_seen"), F.count("*").alias("sightings"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = seen.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def tracked_ids(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The current state: later batches hold newer totals of the ids they touched. No rows before the first batch."""
    log = _log(spark, out)
    if log is None:
        return spark.createDataFrame([], f"`{key}` string, first_seen string, sightings long")
    return last_per_key(log, [key], ["batch"]).drop("batch")


def new_ids(stream: DataFrame, key: str, row_id: Sequence[str], salts: int = 64) -> DataFrame:
    """A stream with each id once, any one of its rows. For use inside a longer streaming plan.

    Two rounds: the first keeps one row per id and salt, so the copies of a hot id are
    dropped by many tasks; the second sees at most ``salts`` rows of any id, ever.
    """
    salted = stream.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)))
    return salted.dropDuplicates([key, "_salt"]).drop("_salt").dropDuplicates([key])


def new_ids_within(
    stream: DataFrame, key: str, row_id: Sequence[str], time: str, delay: str, salts: int = 64
) -> DataFrame:
    """Like ``new_ids`` with bounded state: copies are dropped while within ``delay``."""
    salted = stream.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.lit(salts))).withWatermark(time, delay)
    once = salted.dropDuplicatesWithinWatermark([key, "_salt"]).drop("_salt")
    return once.dropDuplicatesWithinWatermark([key])
