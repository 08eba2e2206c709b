"""Incremental runs over the event files; the final state equals the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.plans.registry import query
from recordloom.session import work_dir
from recordloom.streaming import incremental as I


def _process(batch):
    """Events of kind 'error' fail to process."""
    return batch.withColumn("error", F.when(F.col("event_type") == "error", "Failed to extract"))


def _run(spark, sf):
    out = work_dir(spark, "incremental")
    stream = I.read_stream(spark, f"{sf}/events.parquet").select("event_id", "user_id", "event_type")
    I.run_incremental(stream, f"{out}/log", f"{out}/checkpoint", "event_id", ["event_id"], _process).awaitTermination()
    return f"{out}/log"


@query("incremental_results", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def incremental_results(spark, sf):
    return I.results(spark, _run(spark, sf), "event_id")


@query("incremental_failed", "SELECT event_id, user_id, event_type, 'Failed to extract' AS error FROM events WHERE event_type = 'error'")
def incremental_failed(spark, sf):
    return I.failed(spark, _run(spark, sf), "event_id")


@query(
    "incremental_retry",
    "SELECT event_id, user_id, event_type FROM events",
)
def incremental_retry(spark, sf):
    """After a second try of the failures everything is done."""
    out = _run(spark, sf)
    I.retry_failed(spark, out, "event_id", lambda df: df.withColumn("error", F.lit("")))
    return I.results(spark, out, "event_id")


@query("incremental_keyed", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def incremental_keyed(spark, sf):
    """Keys known by the stream's state; failures stay in the queue, a second run of the stream changes nothing."""
    out = work_dir(spark, "keyed")
    run = I.KeyedRun(spark, out, "event_id", _process)
    for _ in range(2):
        stream = I.read_stream(spark, f"{sf}/events.parquet").select("event_id", "user_id", "event_type")
        run.start(stream, f"{out}/checkpoint", ["event_id"]).awaitTermination()
    return run.results()


@query("seen_ids", "SELECT user_id, min(event_id) AS first_seen, count(*) AS sightings FROM events GROUP BY 1")
def seen_ids(spark, sf):
    out = work_dir(spark, "seen")
    stream = I.read_stream(spark, f"{sf}/events.parquet")
    I.track_ids(stream, "user_id", "event_id", f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return I.tracked_ids(spark, f"{out}/log", "user_id")


@query("new_ids", "SELECT DISTINCT user_id FROM events")
def new_ids(spark, sf):
    """Ids through a streaming de-duplication, written as they first appear."""
    out = work_dir(spark, "new")
    stream = I.new_ids(I.read_stream(spark, f"{sf}/events.parquet"), "user_id", ["event_id"]).select("user_id")
    writer = stream.writeStream.format("parquet").option("path", f"{out}/ids").option("checkpointLocation", f"{out}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/ids")


@query("new_ids_within", "SELECT DISTINCT user_id FROM events")
def new_ids_within(spark, sf):
    """The same with bounded state; the delay covers the whole span of the events."""
    out = work_dir(spark, "within")
    # event times without a zone are read as UTC instants, which watermarks need
    stream = I.read_stream(spark, f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    once = I.new_ids_within(stream, "user_id", ["event_id"], "at", "60 days").select("user_id")
    writer = once.writeStream.format("parquet").option("path", f"{out}/ids").option("checkpointLocation", f"{out}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/ids")
