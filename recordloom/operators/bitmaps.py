"""Counts that merge over runs: sets of record numbers as bitmaps, one small table per batch.

A record is its whole number. A batch writes, per set and stretch of 32,768 numbers, one bitmap of
4 KB; counts over all batches merge those and read no records again. Merging is exact: a record
that several batches hold counts once. Numbers should be dense, as ``number_rows`` makes them, so
that bitmaps are well filled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The set of all records of a batch.
TOTAL = "total"


def set_bitmaps(df: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """(set, bucket, bits): the numbers of all rows as ``total``, and of those that pass each check.

    Rows without a key are in no set. A check that is null does not pass. Bits of one stretch merge
    in the map tasks, so repeated keys and large groups cost no shuffle.
    """
    if TOTAL in checks:
        raise ValueError(f"{TOTAL!r} names the set of all records")
    inside = [F.when(ok, F.lit(name)) for name, ok in checks.items()]
    sets = F.array_compact(F.array(F.lit(TOTAL), *inside))
    number = F.col(key).cast("long")
    placed = df.select(number.alias("n"), sets.alias("sets")).filter("n is not null").select("n", F.explode("sets").alias("set"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("n"))
    return placed.groupBy("set", F.bitmap_bucket_number("n").alias("bucket")).agg(bits.alias("bits"))


class BatchCounts:
    """Bitmaps below ``path``, a folder per batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def add(self, batch: str, df: DataFrame, key: str, checks: Mapping[str, Column]) -> BatchCounts:
        """Write the batch's bitmaps. A batch that is run again replaces its own."""
        set_bitmaps(df, key, checks).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return self

    def merged(self) -> DataFrame:
        """(set, bucket, bits) over all batches."""
        every = self.spark.read.option("basePath", self.path).parquet(self.path)
        return every.groupBy("set", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _sizes(self, sets: Mapping[str, list[str]]) -> DataFrame:
        """One row: for each name, how many numbers its sets hold together."""
        merged = self.merged()
        named = [F.when(F.col("set").isin(of), F.lit(name)) for name, of in sets.items()]
        joined = merged.select("*", F.explode(F.array_compact(F.array(*named))).alias("name"))
        joined = joined.groupBy("name", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        size = F.bitmap_count("bits")
        return joined.agg(*[F.coalesce(F.sum(F.when(F.col("name") == n, size)), F.lit(0)).alias(n) for n in sets])

    def coverage(self, *checks: str) -> DataFrame:
        """One row: the total, and how many records passed each check in some batch."""
        return self._sizes({name: [name] for name in (TOTAL, *checks)})

    def counts(self) -> DataFrame:
        """(set, n) of every set that was written."""
        return self.merged().groupBy("set").agg(F.sum(F.bitmap_count("bits")).alias("n"))

    def completeness(self, wanted: str, done: str) -> DataFrame:
        """As ``quality.completeness``, of two sets; records without a key are in neither."""
        sizes = self._sizes({"wanted": [wanted], "done": [done], "_either": [wanted, done]})
        parts = sizes.withColumns({"open": F.col("_either") - F.col("done"), "extra": F.col("_either") - F.col("wanted")})
        return parts.drop("_either").withColumn("complete", (F.col("open") == 0) & (F.col("extra") == 0))
