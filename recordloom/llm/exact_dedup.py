"""Exact duplicates by progressive refinement: length, then a prefix, then the full content.

Most texts part at the first two steps, which compare a number and a short hash. Only texts
that still share both are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.registry import query
from recordloom.llm.shared import join_counted, keep, read, small

PREFIX = 64
#: White space: deleted before texts are compared.
SPACES = " \t\n\x0b\x0c\r"


def without_spaces(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for char in SPACES:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, and the columns of ``carry``.

    Texts are equal when they are identical without white space; null counts as empty, and all
    empty texts are equal. The row with the most code points in the original text stays, then
    the one with the smallest id; a null id comes after all others. Rows that repeat an id with
    an equal text are one document: each counts in group_size and says the same. ``carry``
    holds expressions over ``docs`` to pass through; other columns are not touched.

    Text is only shuffled if more (length, prefix) pairs are shared than a broadcast may hold,
    and then only to find the rows to read whole. A group of any size is one aggregate and a
    salted join.
    """
    carry = carry or {}
    squeezed = without_spaces(F.col(text))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
        F.octet_length(squeezed).alias("length"),
        F.xxhash64(F.substring(squeezed, 1, PREFIX)).alias("prefix"),
        squeezed.alias("content"),
        *[c.alias(f"carry_{name}") for name, c in carry.items()],
    )
    keys = keep(rows.drop("content"), "exact-keys")
    lengths = keep(keys.groupBy("length").count().filter("count > 1").select("length"), "exact-lengths")
    same_length = keys.join(small(lengths), "length", "left_semi")
    suspects = same_length.groupBy("length", "prefix").agg(F.count("*").alias("n")).filter("n > 1")
    suspects = keep(suspects, "exact-suspects")
    pair = ["length", "prefix"]
    alone = keys.join(small(suspects.select(*pair)), pair, "left_anti")

    read_whole = rows.join(small(suspects.select(*pair)), pair, "left_semi")
    read_whole = keep(read_whole.withColumn("full", F.sha2("content", 256)).drop("content", "prefix"), "exact-read")
    order = F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id")
    groups = read_whole.groupBy("length", "full").agg(
        F.min_by(F.struct("doc_id"), order).alias("best"), F.count("*").alias("n")
    )
    groups = keep(groups.select("length", "full", F.col("best.doc_id").alias("keep_id"), "n"), "exact-groups")
    found = join_counted(read_whole, groups, ["length", "full"], "n", ["doc_id"])

    carried = [F.col(f"carry_{name}").alias(name) for name in carry]
    return alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carried
    ).unionAll(
        found.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *carried)
    )


@query(
    "op6_exact_dedup",
    """
    with t as (
      select doc_id, length(coalesce(text, '')) as points,
        sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256
      from documents)
    select doc_id,
      first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as keep_id,
      count(*) over (partition by text_sha256) as group_size,
      doc_id = first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as kept,
      text_sha256
    from t
    """,
)
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.sha2(without_spaces(F.col("text")), 256)
    return exact_groups(read(spark, folder, "documents"), carry={"text_sha256": digest})
