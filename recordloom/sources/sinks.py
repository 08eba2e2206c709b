"""Writers: JSON, upload batches, envelopes, flat CSV, one folder per unit, paper CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import or_empty
from recordloom.operators.quality import UPLOAD_LIMIT, upload_batches

LIST_SEPARATOR = " | "
# Characters that may not stand in a file name.
UNSAFE_IN_NAMES = r'[<>:"/\\|?*]'
PAPER_HEADERS = ["Title", "Authors", "Venue", "Affinity Score", "Link", "Keywords"]


def write_json(df: DataFrame, path: str) -> None:
    """One record per line, characters as they are."""
    df.write.mode("overwrite").json(path)


def record_arrays(df: DataFrame, key: str, size: int = UPLOAD_LIMIT) -> DataFrame:
    """(batch, value): JSON arrays of at most ``size`` records, in key order."""
    columns = df.columns
    batched = upload_batches(df, key, size)
    listed = F.array_sort(F.collect_list(F.struct(F.col(key).alias("_k"), F.struct(*columns).alias("r"))))
    return batched.groupBy("batch").agg(F.to_json(F.transform(listed, lambda x: x["r"])).alias("value"))


def write_record_arrays(df: DataFrame, path: str, key: str, size: int = UPLOAD_LIMIT) -> None:
    record_arrays(df, key, size).select("value").write.mode("overwrite").text(path)


def write_envelopes(
    df: DataFrame, path: str, items: str, key: str, venue: Column, year: Column, size: int = UPLOAD_LIMIT
) -> None:
    """{venue, year, items: [...]} lines: every venue and year in batches of ``size`` items, the last one smaller."""
    columns = df.columns
    batched = upload_batches(df.withColumns({"_venue": venue, "_year": year}), key, size, ["_venue", "_year"])
    listed = F.array_sort(F.collect_list(F.struct(F.col(key).alias("_k"), F.struct(*columns).alias("r"))))
    envelopes = batched.groupBy("_venue", "_year", "batch").agg(F.transform(listed, lambda x: x["r"]).alias(items))
    value = F.to_json(F.struct(F.col("_venue").alias("venue"), F.col("_year").alias("year"), items))
    envelopes.select(value.alias("value")).write.mode("overwrite").text(path)


def flatten(
    df: DataFrame, columns: Sequence[str], lists: Sequence[str] = (), people: Sequence[str] = ()
) -> DataFrame:
    """Text columns for CSV: lists joined by ' | ', people as JSON, missing as '', others dropped."""
    out = []
    for c in columns:
        if c in lists:
            value = F.array_join(c, LIST_SEPARATOR)
        elif c in people:
            value = F.to_json(F.coalesce(F.col(c), F.array().cast(dict(df.dtypes)[c])), {"ignoreNullFields": "false"})
        else:
            value = F.col(c).cast("string")
        out.append(or_empty(value).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), quote_all: bool = False) -> None:
    """CSV with header, doubled quotes and outer blanks kept."""
    writer = df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    writer = writer.option("quoteAll", str(quote_all).lower()).option("emptyValue", "")
    writer.partitionBy(*partition_by).csv(path)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, UNSAFE_IN_NAMES, "_")


def write_per_unit(df: DataFrame, path: str, unit: str) -> None:
    """A CSV folder per unit under its sanitised name.

    Rows are rebalanced by unit: small units end up in one file, and adaptive execution
    splits a unit that holds too much for one task over several.
    """
    named = df.withColumn(unit, safe_name(F.col(unit)))
    write_csv(named.hint("rebalance", unit), path, [unit])


def paper_csv_lines(papers: DataFrame) -> DataFrame:
    """The line of each paper in the six-column export: texts quoted, a missing score is 0."""

    def quoted(c: str) -> Column:
        return F.concat(F.lit('"'), F.replace(or_empty(F.col(c)), F.lit('"'), F.lit('""')), F.lit('"'))

    score = F.coalesce(F.nullif("affinity_score", F.lit(0.0)), F.lit(0.0))
    whole = score == F.floor(score)
    number = F.when(whole, score.cast("long").cast("string")).otherwise(score.cast("string"))
    line = F.concat_ws(",", quoted("title"), quoted("authors"), quoted("venue"), number, quoted("link"), quoted("keywords"))
    return papers.withColumn("line", line)


def write_papers_csv(papers: DataFrame, path: str) -> None:
    """The export as text files, each with the bare header line and then one line per paper."""
    # a file holds one partition, whose first row has a number that ends in 33 zero bits
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) == 0
    header = F.lit(",".join(PAPER_HEADERS) + "\n")
    lines = paper_csv_lines(papers).select(F.when(first, F.concat(header, "line")).otherwise(F.col("line")).alias("value"))
    lines.write.mode("overwrite").text(path)
