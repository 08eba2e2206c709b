"""De-duplication and merging of labels, people and text per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import or_empty
from recordloom.operators.scale import first_per_key

# No cell of the ``_parts`` functions holds more than this many entries: longer ones continue in the next part.
PART_SIZE = 10_000


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key over ordered batches."""
    return first_per_key(df, keys, order)


TIME_PREFIX = r"^\d+:\d+[ap]m\s*-\s*\d+:\d+[ap]m\s*"


def prefer_full_titles(
    df: DataFrame, key: str, title: str, order: Sequence[str], mode: str = "prefer_full"
) -> DataFrame:
    """One title per key after removing a '9:00am - 5:00pm' prefix.

    ``prefer_full``: the last title not ending in '...', else the first one.
    ``compat``: the last title when it is full, else the first title of the cut-off run at
    the end, which lets a later cut-off title replace a full one.
    Both are aggregates, so a key with many rows merges before the shuffle.
    """
    if mode not in ("prefer_full", "compat"):
        raise ValueError(f"unknown mode {mode!r}")
    clean = F.regexp_replace(or_empty(F.col(title)), TIME_PREFIX, "")
    base = df.select(key, clean.alias(title), F.struct(*order).alias("_at"))
    cut = F.endswith(F.col(title), F.lit("..."))
    if mode == "prefer_full":
        return base.groupBy(key).agg(
            F.coalesce(
                F.max_by(title, F.when(~cut, F.col("_at"))), F.min_by(title, F.col("_at"))
            ).alias(title)
        )
    last_full = base.filter(~cut).groupBy(key).agg(F.max("_at").alias("_last_full"), F.max_by(title, "_at").alias("_full"))
    after = base.filter(cut).join(last_full.select(key, "_last_full"), key, "left")
    after = after.filter(F.col("_last_full").isNull() | (F.col("_at") > F.col("_last_full")))
    run = after.groupBy(key).agg(F.min_by(title, "_at").alias("_cut"))
    return run.join(last_full, key, "full_outer").select(key, F.coalesce("_cut", "_full").alias(title))


def ordered_distinct(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """One row per (key, value) with ``_at``, its first place. Copies merge before the shuffle."""
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return df.groupBy(key, value).agg(F.min(place).alias("_at"))


def distinct_lists(df: DataFrame, key: str, value: str, order: Sequence[str], out: str) -> DataFrame:
    """Per key the distinct values in order of first appearance.

    For values from a vocabulary (types, themes, flags): a list is as long as the
    vocabulary at most. For open-ended values use ``distinct_list_parts``.
    """
    pairs = ordered_distinct(df, key, value, order)
    listed = F.array_sort(F.collect_list(F.struct("_at", value)))
    return pairs.groupBy(key).agg(F.transform(listed, lambda s: s[value]).alias(out))


def distinct_list_parts(
    df: DataFrame, key: str, value: str, position: str, out: str, part_size: int = PART_SIZE
) -> DataFrame:
    """Like ``distinct_lists`` over a whole-number ``position``, in parts of bounded length.

    ``part`` counts from 0 by first position; for a key below ``part_size`` it is one row.
    """
    pairs = df.groupBy(key, value).agg(F.min(position).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", value)))
    return (
        pairs.withColumn("part", F.floor(F.col("_at") / part_size))
        .groupBy(key, "part")
        .agg(F.transform(listed, lambda s: s[value]).alias(out))
    )


def merge_labels(df: DataFrame, key: str, label: str, order: Sequence[str], out: str = "labels") -> DataFrame:
    """One row per key with its distinct labels; ``shared`` marks keys with more than one."""
    merged = distinct_lists(df, key, label, order, out)
    return merged.withColumn("shared", F.size(out) > 1)


def invert_membership(
    members: DataFrame, theme: str, ids: str, theme_order: str, key: str, out: str
) -> DataFrame:
    """theme -> [ids] to id -> [themes], themes in their own order."""
    pairs = members.select(theme, theme_order, F.explode(ids).alias(key))
    return distinct_lists(pairs, key, theme, [theme_order], out)


def _lines_in_order(position: str, category: str, text: str):
    line = F.concat(F.lit("["), F.trim(F.col(category)), F.lit("] "), F.col(text))
    listed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), line.alias("l"))))
    return F.array_join(F.transform(listed, lambda s: s["l"]), "\n").alias("unit_text")


def text_per_unit(df: DataFrame, unit: str, position: str, category: str, text: str) -> DataFrame:
    """'[category] text' lines per unit in order, joined by newlines: one row per unit.

    For units whose text fits in a cell, as statements of interest do.
    """
    return df.groupBy(unit).agg(_lines_in_order(position, category, text))


def text_parts(
    df: DataFrame, unit: str, position: str, category: str, text: str, part_size: int = PART_SIZE
) -> DataFrame:
    """Like ``text_per_unit`` for units of any length, in rows (unit, part, unit_text).

    A part covers ``part_size`` positions; the parts joined by newlines are the whole text.
    """
    parted = df.withColumn("part", F.floor(F.col(position) / part_size))
    return parted.groupBy(unit, "part").agg(_lines_in_order(position, category, text))
