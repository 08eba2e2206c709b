"""Building blocks that keep one hot key, group or side from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from recordloom.session import work_dir

MAX_BROADCAST_ROWS = 20_000
MAX_BROADCAST_BYTES = 128 * 1024 * 1024
# Keys a sketch keeps count of: those above about a thousandth of all rows are never missed.
SKETCH_ITEMS = 4_096


def small_or_shuffled(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast only after measuring that the side is within ``max_rows`` and ``max_bytes``.

    Beyond that the frame is returned as it is and Spark shuffles the join. Measuring reads
    the side once, up to ``max_rows + 1`` rows, so use it for sides that are cheap to compute.
    """
    width = F.sum(F.length(F.to_json(F.struct(*df.columns))).cast("long"))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), width).first()
    if rows <= max_rows and (size or 0) <= max_bytes:
        return F.broadcast(df)
    return df


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first by ``order``. An aggregate, so copies merge before the shuffle."""
    return _one_per_key(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the last by ``order`` (a table where later rows overwrite)."""
    return _one_per_key(df, keys, order, F.max_by)


def _one_per_key(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def top_k(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Sequence[str],
    rank: str = "rank",
    salts: int = 64,
) -> DataFrame:
    """Ranks 1..k per group, in two rounds so that no task sorts a whole group.

    Round one ranks inside ``salts`` slices of each group (Spark also cuts each map
    task to k rows per slice); round two ranks the at most ``salts * k`` survivors.
    ``spread`` names columns that tell the rows of a group apart.
    """
    slice_ = F.pmod(F.xxhash64(*spread), F.lit(salts))
    sliced = df.withColumn("_slice", slice_)
    first = Window.partitionBy(*group, "_slice").orderBy(*order)
    heads = sliced.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        heads.drop("_slice", "_rn").withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)
    )


def number_rows(df: DataFrame, key: str, name: str = "row_no", parts: int | None = None, group: Sequence[str] = ()) -> DataFrame:
    """1..n in ascending order of a key of any type, without one task sorting everything.

    Whole rows are dealt to ranges of about as many rows each, whatever the spread of the keys, are
    sorted and written with their places in the range; a row's number is its place and the
    count of all rows before the range. With ``group`` every group of those columns has its own
    1..n; it is the leading part of the order.

    Every row comes out once. Rows without a key come first; rows of one key have numbers next to
    each other in an order that a hash of the row decides, by which a hot key is also parted.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]  # what has a hash
    order = [*group, F.asc_nulls_first(key), F.xxhash64(*plain)]
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    path = work_dir(spark, "ranges")
    # ids count a partition's rows in their lower 33 bits; written, so that both uses below see the same ranges
    placed = ranged.withColumn("_id", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit(2**33 - 1))).drop("_id")

    # a row per range and, with groups, per group in it
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_least"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    marks = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least") + 1
    offsets = small_or_shuffled(counts.select(*marks, F.col("_part").alias("_of"), offset.alias("_offset")))
    same = F.col("_part") == F.col("_of")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(offsets, same).select(*df.columns, (F.col("_place") + F.col("_offset")).alias(name))


def carry_forward(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    segment: Column,
) -> DataFrame:
    """Fill nulls with the last value above, in ``order`` inside each group.

    ``segment`` must grow with the order (for instance ``floor(pos / 100000)``). Rows are
    filled inside their segment; what a segment inherits comes from a small table with
    one row per segment, so a huge group is spread over many tasks.
    """
    cut = df.withColumn("_segment", segment)
    inside = (
        Window.partitionBy(*group, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    before = (
        Window.partitionBy(*group).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    )
    tails = cut.groupBy(*group, "_segment").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_tail_{c}")
            for c in columns
        ]
    )
    inherited = tails.select(
        *group,
        "_segment",
        *[F.last(f"_tail_{c}", ignorenulls=True).over(before).alias(f"_above_{c}") for c in columns],
    )
    filled = cut.select(
        *[c for c in df.columns if c not in columns],
        "_segment",
        *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in columns],
    )
    return filled.join(inherited, [*group, "_segment"], "left").select(
        *[
            F.coalesce(F.col(c), F.col(f"_above_{c}")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    row_id: Sequence[str],
    how: str = "left",
    salts: int = 64,
    min_rows: int = 1_000_000,
    max_hot: int = 1_000,
    max_small: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join a many-rows side to a side with unique keys, spreading the hot keys.

    A right side of at most ``max_small`` rows is measured and broadcast: no key is hot then.
    Beyond that:
    A frequent-items sketch over the key column (one small partial result per task, no
    shuffle of keys) names the at most ``max_hot`` keys with about ``min_rows`` rows or
    more. Those are salted on the left and copied once per salt on the right; every other
    key joins as usual. Which keys get salted changes the spread, never the result. The
    list is bounded by ``max_hot``, hence broadcast. ``row_id`` tells left rows apart.
    """
    measured = small_or_shuffled(right, max_small) if max_small else right
    if measured is not right:
        return left.join(measured, list(on), how)
    key_hash = F.xxhash64(*on)
    sketch = F.expr(f"approx_top_k(_key, {max_hot}, {SKETCH_ITEMS})")
    hot = (
        left.select(key_hash.alias("_key"))
        .agg(sketch.alias("_top"))
        .select(F.inline("_top"))
        .filter(F.col("count") >= min_rows)
        .select(F.col("item").alias("_key"), F.lit(True).alias("_hot"))
    )
    zero = F.lit(0).cast("long")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*row_id), F.lit(salts))).otherwise(zero)
    spread = left.withColumn("_key", key_hash).join(F.broadcast(hot), "_key", "left")
    spread = spread.withColumn("_salt", salt).drop("_key", "_hot")
    copies = F.when(F.col("_hot"), F.sequence(zero, zero + (salts - 1))).otherwise(F.array(zero))
    copied = right.withColumn("_key", key_hash).join(F.broadcast(hot), "_key", "left")
    copied = copied.withColumn("_salt", F.explode(copies)).drop("_key", "_hot")
    return spread.join(copied, [*on, "_salt"], how).drop("_salt")
