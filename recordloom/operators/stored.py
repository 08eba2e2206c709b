"""A stored keyed table in key buckets, of which an update reads and writes those it touches.

A row's bucket is a hash of its key, and every bucket is a folder. An update names its buckets, at
most as many as there are; only those are read, merged and overwritten, in one commit of the
writer. All other files stay as they are, names included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.match import keep
from recordloom.operators.reconcile import replace_rows, upsert

#: The column of folders. Buckets should hold some hundred megabytes; their number is fixed once written.
BUCKET = "bucket"
BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    """Null keys have a bucket too."""
    return F.pmod(F.xxhash64(F.lit("stored"), key), F.lit(buckets)).cast("int")


class StoredTable:
    """A table below ``path`` with one row per ``key``. ``buckets`` must be what it was written with."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def create(self, rows: DataFrame) -> StoredTable:
        """Write ``rows`` as the whole table; their keys are unique."""
        self._write(rows, "static")
        return self

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def touched(self, updates: DataFrame) -> list[int]:
        """The buckets of the keys in ``updates``: at most ``buckets`` numbers."""
        found = updates.select(bucket_of(self.key, self.buckets).alias(BUCKET)).distinct().collect()
        return sorted(r[BUCKET] for r in found)

    def only(self, buckets: Sequence[int]) -> DataFrame:
        """The rows of some buckets; the folders of the others are not listed or read."""
        return self._stored().filter(F.col(BUCKET).isin(list(buckets))).drop(BUCKET)

    def upsert(self, updates: DataFrame, order: Sequence[str]) -> list[int]:
        """Rows of ``updates`` overwrite those of their keys, the last by ``order`` wins; the buckets written.

        Columns that ``updates`` lacks are null in its rows. Running the same update again changes
        nothing, so a run that was cut off is simply repeated.
        """
        updates = keep(updates, "stored-updates")
        buckets = self.touched(updates)
        if buckets:
            base = self.only(buckets)
            rest = [F.lit(None).cast(t).alias(c) for c, t in base.dtypes if c not in updates.columns]
            extra = [F.lit(None).cast(dict(updates.dtypes)[c]).alias(c) for c in order if c not in base.columns]
            merged = upsert(base.select("*", *extra), updates.select("*", *rest), self.key, order)
            self._write(merged.select(*base.columns), "dynamic")
        return buckets

    def replace(self, fresh: DataFrame, kept: Sequence[str], fresh_id: str, order: Sequence[str] = ()) -> list[int]:
        """``reconcile.replace_rows`` on the buckets that ``fresh`` touches; the buckets written."""
        fresh = keep(fresh, "stored-fresh")
        buckets = self.touched(fresh)
        if buckets:
            self._write(replace_rows(self.only(buckets), fresh, self.key, kept, fresh_id, order), "dynamic")
        return buckets

    def _write(self, rows: DataFrame, mode: str) -> None:
        """Overwrite the whole table, or the buckets of ``rows``: from a kept copy, as they may come from the table itself."""
        rows = keep(rows.withColumn(BUCKET, bucket_of(self.key, self.buckets)), "stored-rows")
        writer = rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", mode)
        writer.partitionBy(BUCKET).parquet(self.path)
