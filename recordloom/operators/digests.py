"""Snapshots compared by digests of key buckets, so that only what changed is joined.

A bucket's digest is its row count, and the sum and the exclusive or of its rows' hashes: it does
not depend on the order of rows, and it merges, so a task sums up its own rows. Buckets have two
levels. The coarse digests of a stored snapshot are a few hundred rows; the fine ones of coarse
buckets that differ say which rows have to meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.reconcile import snapshot_diff
from recordloom.operators.scale import first_per_key

#: Buckets of the first level, and parts of each on the second.
COARSE, FINE = 256, 256


def bucket_of(key: str) -> list[Column]:
    """The coarse and the fine bucket of a key. Null keys are a key of their own here."""
    number = F.pmod(F.xxhash64(F.lit("bucket"), key), F.lit(COARSE * FINE)).cast("int")
    return [F.floor(number / FINE).cast("int").alias("coarse"), (number % FINE).alias("fine")]


def _row_hash(seed: int, columns: Sequence[str]) -> Column:
    # hashes pass over nulls, so where they are is hashed too
    return F.xxhash64(F.lit(seed), *columns, *[F.col(c).isNull() for c in columns])


def snapshot_digests(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(coarse, fine, n, total, mixed): a digest per fine bucket over ``key`` and ``columns``. At most COARSE * FINE rows.

    To be kept with a snapshot: comparing it later then reads only what differs.
    """
    marked = df.select(*bucket_of(key), *[_row_hash(i, [key, *columns]).alias(f"h{i}") for i in (1, 2)])
    return marked.groupBy("coarse", "fine").agg(
        F.count("*").alias("n"), F.sum(F.col("h1").cast("decimal(38,0)")).alias("total"), F.bit_xor("h2").alias("mixed")
    )


def coarser(digests: DataFrame) -> DataFrame:
    """(coarse, n, total, mixed) from the digests of fine buckets. At most COARSE rows."""
    return digests.groupBy("coarse").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed"))


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """The fine buckets (coarse, fine, old_n, new_n) whose digests differ; looked for in coarse ones that differ only."""

    def unlike(a: DataFrame, b: DataFrame, level: list[str]) -> DataFrame:
        parts = ("n", "total", "mixed")
        a = a.select(*level, *[F.col(c).alias(f"old_{c}") for c in parts])
        b = b.select(*level, *[F.col(c).alias(f"new_{c}") for c in parts])
        same = [F.equal_null(f"old_{c}", f"new_{c}") for c in parts]
        return a.join(b, level, "full_outer").filter(~(same[0] & same[1] & same[2]))

    coarse = F.broadcast(unlike(coarser(old), coarser(new), ["coarse"]).select("coarse"))  # at most COARSE rows
    fine = unlike(old.join(coarse, "coarse", "left_semi"), new.join(coarse, "coarse", "left_semi"), ["coarse", "fine"])
    return fine.select("coarse", "fine", F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"))


def only_buckets(df: DataFrame, key: str, buckets: DataFrame) -> DataFrame:
    """The rows of ``df`` in ``buckets`` (coarse, fine; at most COARSE * FINE rows, so broadcast)."""
    return df.withColumns(dict(zip(("_coarse", "_fine"), bucket_of(key)))).join(
        F.broadcast(buckets.select(F.col("coarse").alias("_coarse"), F.col("fine").alias("_fine"))), ["_coarse", "_fine"], "left_semi"
    ).drop("_coarse", "_fine")


def changed_rows(
    old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], order: Sequence[str] | None = None,
    old_digests: DataFrame | None = None, new_digests: DataFrame | None = None,
) -> DataFrame:
    """What ``snapshot_diff(..., compare=columns)`` returns but for its 'common' rows: added, removed and changed.

    Only rows of buckets that differ are joined; of unchanged ones nothing but the digest is
    used, and with stored digests not even that is read from them. Keys and ``order`` as there.
    """
    if order is not None:
        old, new = first_per_key(old, [key], order), first_per_key(new, [key], order)
    old_digests = snapshot_digests(old, key, columns) if old_digests is None else old_digests
    new_digests = snapshot_digests(new, key, columns) if new_digests is None else new_digests
    buckets = differing(old_digests, new_digests)
    diff = snapshot_diff(only_buckets(old, key, buckets), only_buckets(new, key, buckets), key, compare=columns)
    return diff.filter("change <> 'common'")


def change_counts(changed: DataFrame, old_digests: DataFrame) -> DataFrame:
    """(change, n) of all rows, the 'common' ones too, from the rows that changed and the old snapshot's digests."""
    n = changed.groupBy("change").agg(F.count("*").alias("n"))
    was = old_digests.select(F.lit("common").alias("change"), "n")
    gone = n.filter(F.col("change").isin("removed", "changed")).select(F.lit("common").alias("change"), -F.col("n"))
    return n.unionAll(was).unionAll(gone).groupBy("change").agg(F.sum("n").alias("n")).filter("n > 0")
