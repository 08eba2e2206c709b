"""Readers: JSON arrays, envelopes, nested maps, CSV, text records, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import lines, or_empty
from recordloom.schemas import PAGE

SEPARATOR = "-" * 80


def read_records(spark: SparkSession, path: str, schema: str, pretty: bool = False) -> DataFrame:
    """JSON records, one or an array of them per line; ``pretty`` for files laid out over lines.

    The line form splits across tasks; a pretty file is one task's work, so keep those small.
    """
    return spark.read.schema(schema).option("multiLine", str(pretty).lower()).json(path)


def read_labelled(
    spark: SparkSession, path: str, schema: str, pattern: str, label: str, pretty: bool = False
) -> DataFrame:
    """Records of several files with a label taken from each file's path by ``pattern``."""
    records = read_records(spark, path, schema, pretty)
    return records.select("*", F.regexp_extract("_metadata.file_path", pattern, 1).alias(label))


def read_envelope(
    spark: SparkSession, path: str, items: str, item: str, pretty: bool = False
) -> DataFrame:
    """{venue, year, items: [...]} -> one row per item with venue and year."""
    schema = f"venue string, year int, {items} array<struct<{item}>>"
    return read_records(spark, path, schema, pretty).select("venue", "year", F.inline(items))


def read_nested_map(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """unit -> category -> [text] as rows, with the place of each in the file.

    ``whole_file=False`` reads one such map per line.
    """
    raw = spark.read.text(path, wholetext=whole_file)
    parsed = raw.select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    units = parsed.select(F.posexplode("m").alias("unit_pos", "unit", "categories"))
    categories = units.select("unit_pos", "unit", F.posexplode("categories").alias("category_pos", "category", "texts"))
    return categories.select(
        "unit_pos", "unit", "category_pos", "category", F.posexplode("texts").alias("text_pos", "text")
    )


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header as text columns; a missing value is ''. Columns the file lacks are ''.

    Quoted values may hold line breaks, so one file is one task: write many files.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return raw.select(
        *[or_empty(F.col(f"`{c}`")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns]
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The raw-page table."""
    return spark.read.schema(PAGE).parquet(path)


def read_text_records(spark: SparkSession, path: str) -> DataFrame:
    """'Key: value' records with a BibTeX block, set apart by a line of 80 dashes."""
    raw = spark.read.option("lineSep", SEPARATOR).text(path)
    return parse_text_records(raw, "value")


def parse_text_records(raw: DataFrame, text: str) -> DataFrame:
    """Records from one text per row. The last line of a key counts, also inside BibTeX."""

    def last_value(prefix: str) -> Column:
        found = F.filter("_lines", lambda x: F.startswith(x, F.lit(prefix)))
        return F.substr(F.try_element_at(found, F.lit(-1)), F.lit(len(prefix) + 1))

    score = last_value("Affinity Score: ")
    # Java reads '1d' as a number, which the format does not
    number = F.when(~score.rlike(r"\d[dDfF]$"), score).try_cast("double")
    is_mark = lambda x: F.startswith(x, F.lit("BibTeX:"))
    start = F.array_position(F.transform("_lines", is_mark), F.lit(True)).cast("int")
    block = F.filter(F.slice("_lines", start + 1, F.size("_lines")), lambda x: ~is_mark(x))
    bibtex = F.when(start > 0, F.nullif(F.array_join(block, "\n"), F.lit("")))
    records = raw.withColumn("_lines", lines(F.col(text))).select(
        last_value("Title: ").alias("title"),
        last_value("Authors: ").alias("authors"),
        last_value("Venue: ").alias("venue"),
        F.when(score.isNotNull(), F.coalesce(number, F.lit(0.0))).alias("affinity_score"),
        last_value("Link: ").alias("link"),
        last_value("Keywords: ").alias("keywords"),
        bibtex.alias("bibtex"),
    )
    return records.filter(F.col("title").isNotNull())


def union_labelled(batches: dict[str, DataFrame], label: str) -> DataFrame:
    """Several batches as one frame with a label; columns a batch lacks are null."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in batches.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
