"""A training corpus from raw documents: each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.byte_bpe import RANKS, round_trip
from recordloom.llm.exact_dedup import exact_groups
from recordloom.llm.mixing import Mix
from recordloom.llm.near_dedup import near_groups
from recordloom.llm.shared import keep, read, row_key, small
from recordloom.llm.toxicity import fit_toxicity, without_toxic


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(keyed: DataFrame, groups: DataFrame, row: str) -> DataFrame:
    """The rows of ``keyed`` that ``groups``, made over its row keys, keeps; one of rows that are the same throughout."""
    one, two = hashes = free_name(keyed, "one"), free_name(keyed, "two")
    rows = groups.select(F.col("doc_id.one").alias(one), F.col("doc_id.two").alias(two), "kept")
    rows = keep(rows.groupBy(*hashes).agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("n > 1 or not kept"), "verdicts")
    gone, same = rows.filter("not kept").select(*hashes), rows.filter("kept").select(*hashes)
    named = keyed.withColumns({one: F.col(row).getField("one"), two: F.col(row).getField("two")}).drop(row)
    left = named.join(small(gone), [*hashes], "left_anti")
    once = left.join(small(same), [*hashes], "left_anti")
    again = left.join(small(same), [*hashes], "left_semi").dropDuplicates([*hashes])
    return once.unionAll(again).drop(*hashes)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the graded model rejects go; it is fitted on the labelled ones of ``docs``."""
    return without_toxic(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest writing of each text stays, in one row, also where ids are null or repeated."""
    row = free_name(docs, "row")
    keyed = docs.withColumn(row, row_key(docs))
    return without(keyed, exact_groups(keyed, row), row)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    row = free_name(docs, "row")
    keyed = docs.withColumn(row, row_key(docs))
    return without(keyed, near_groups(keyed, row), row)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportion of their weights: a row per document and repeat, with the words taken."""
    mixed = Mix(docs).texts(docs)
    kinds = dict(docs.dtypes)
    return mixed.withColumn("n_chars", F.char_length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else mixed


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the bytes they decode to, as digests."""
    return round_trip(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("byte_bpe", tokenize),
]

#: Neither a trained model nor a tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = keep(docs, f"pipeline-{name}")
    return docs
