"""What the operators share: intermediate tables, measured broadcasts, joins with hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import short_batches, work_dir  # noqa: F401

#: Sides up to this many rows of a few short columns are broadcast; they are counted first.
SMALL_ROWS = 200_000
#: At most this many keys can be hot, as each holds a thousandth of all rows or more.
HOT_SHARE = 1_000
SALTS = 64


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder all executors share and read it back: cuts the lineage."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame, doc_id: str = "doc_id") -> Column:
    """A key of every row by all its columns, for rows whose ids may be null or repeated.

    Keys are ordered as ids are, null last, then by two 64-bit hashes. Only rows that are the
    same throughout share a key.
    """
    whole = [*df.columns, *[F.col(c).isNull() for c in df.columns]]  # hashes pass over nulls
    hashes = [F.xxhash64(F.lit(i), *whole).alias(name) for i, name in enumerate(("one", "two"))]
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), *hashes)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast a kept table of short columns if it has at most ``rows`` rows, else join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_counted(
    left: DataFrame, right: DataFrame, keys: Sequence[str], n: str, salt_on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join ``left`` to ``right``, whose keys are unique and whose column ``n`` counts their left rows.

    Keys with a thousandth of the rows or more (so at most a thousand of them, which is why
    their list may be broadcast) are dealt over ``SALTS`` tasks by a hash of ``salt_on``;
    the right row is copied to each.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    least = max(total // HOT_SHARE, 100)
    hot = right.filter(F.col(n) >= least).select(*keys, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_on), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    copies = F.when(F.col(n) >= least, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    copies = F.coalesce(copies, F.array(F.lit(0).cast("long")))
    spread = left.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt).drop("_hot")
    return spread.join(right.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], how).drop("_salt")
