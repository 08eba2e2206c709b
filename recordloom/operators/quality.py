"""Filters, field rules and counts that say whether a record table is fit to publish."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import contains_ci, first_value, missing
from recordloom.operators.scale import number_rows

UPLOAD_LIMIT = 1000

# Other names a field of an upload may come under.
FIELD_ALIASES = {
    "session_id": "code",
    "room": "location",
    "session_type": "sessionType",
    "topic": "mainTopic",
    "key_themes": "keyThemes",
}
REQUIRED_FIELDS = ["title", "date", "start", "end"]
# What the published formats accept.
FLAT_FORMATS = ["In-Person", "Virtual", "Both"]
ENVELOPE_FORMATS = ["IN_PERSON", "VIRTUAL", "BOTH"]
RECORDING_VALUES = ["Yes", "No"]
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"
TIME_SHAPE = r"^([01]\d|2[0-3]):[0-5]\d$"


def only_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is null or ''. Positions are a column of the input and stay."""
    return df.filter(missing(F.col(column)))


def any_missing(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with a key and at least one missing column."""
    gap = F.lit(False)
    for c in columns:
        gap = gap | missing(F.col(c))
    return df.filter(~missing(F.col(key)) & gap)


def keep_categories(df: DataFrame, column: str, words: Sequence[str], label: str = "category") -> DataFrame:
    """Rows naming one of ``words``; the first word of the list found is the label."""
    chain = F.lit(None).cast("string")
    for word in reversed(words):
        chain = F.when(contains_ci(F.col(column), word), F.lit(word)).otherwise(chain)
    return df.withColumn(label, chain).filter(F.col(label).isNotNull())


def search(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows holding ``query`` in any of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains_ci(F.col(c), query)
    return df.filter(hit)


def paper_display(df: DataFrame) -> DataFrame:
    """Fields of a paper as shown: placeholders for missing ones, scores with four decimals."""
    score = F.col("affinity_score")
    return df.withColumns(
        {
            "link": first_value(F.col("link"), "#"),
            "title": first_value(F.col("title"), "Untitled"),
            "authors": first_value(F.col("authors"), "Unknown Authors"),
            "venue": first_value(F.col("venue"), "Unknown Venue"),
            "affinity_score": F.when(
                F.coalesce(score, F.lit(0.0)) != 0.0, F.format_string("%.4f", score)
            ).otherwise("N/A"),
        }
    )


def split_required(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rejected rows name the required fields they lack."""
    marked = mark_required(df, required)
    kept = marked.filter(F.size("lacking") == 0).drop("lacking")
    return kept, marked.filter(F.size("lacking") > 0)


def mark_required(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    lacking = F.filter(
        F.array(*[F.when(missing(F.col(c)), F.lit(c)) for c in required]), lambda x: x.isNotNull()
    )
    return df.withColumn("lacking", lacking)


def resolve_aliases(df: DataFrame, aliases: Mapping[str, str] = FIELD_ALIASES) -> DataFrame:
    """Fill each field from its alias when missing, and drop the alias."""
    for field, alias in aliases.items():
        if alias not in df.columns:
            continue
        if field not in df.columns:
            df = df.withColumnRenamed(alias, field)
            continue
        value = F.col(field)
        if dict(df.dtypes)[field] == "string":
            value = F.nullif(value, F.lit(""))
        df = df.withColumn(field, F.coalesce(value, F.col(alias))).drop(alias)
    return df


def field_errors(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that do not hold; a rule that yields null does not hold."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def optional(column: str, ok: Column) -> Column:
    """A rule for a field that may be missing."""
    return missing(F.col(column)) | ok


def flat_session_rules() -> dict[str, Column]:
    return {
        "date": F.col("date").rlike(DATE_SHAPE),
        "start": F.col("start").rlike(TIME_SHAPE),
        "end": F.col("end").rlike(TIME_SHAPE),
        "format": optional("format", F.col("format").isin(FLAT_FORMATS)),
        "recording": optional("recording", F.col("recording").isin(RECORDING_VALUES)),
    }


def envelope_session_rules() -> dict[str, Column]:
    return {"sessionFormat": optional("sessionFormat", F.col("sessionFormat").isin(ENVELOPE_FORMATS))}


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``errors``; rows are never dropped here."""
    return df.withColumn("errors", field_errors(rules))


def default_recording(df: DataFrame) -> DataFrame:
    return df.withColumn("hasRecording", F.coalesce("hasRecording", F.lit(False)))


def upload_batches(df: DataFrame, key: str, size: int = UPLOAD_LIMIT, group: Sequence[str] = ()) -> DataFrame:
    """Batch numbers from 0, at most ``size`` rows each, in key order, in every group of its own."""
    numbered = number_rows(df, key, "_row", group=group)
    return numbered.withColumn("batch", F.floor((F.col("_row") - 1) / size)).drop("_row")


def project(df: DataFrame, names: Mapping[str, str], constants: Mapping[str, object] | None = None) -> DataFrame:
    """Rename (new -> old), keep only those columns, add constants."""
    constants = constants or {}
    return df.select(
        *[F.col(old).alias(new) for new, old in names.items()],
        *[F.lit(v).alias(k) for k, v in constants.items()],
    )


def report_head(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows for a report, each with the count of all rows."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total", total)


def agenda(df: DataFrame, order: Sequence[Column | str] = ("date", "startTime", "title")) -> DataFrame:
    """Rows in programme order (a range-partitioned sort)."""
    return df.orderBy(*order)


def split_errors(df: DataFrame, keep: Sequence[str], error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(ok, failed): failed rows carry only ``keep`` and the error."""
    failed = df.filter(~missing(F.col(error))).select(*keep, error)
    return df.filter(missing(F.col(error))).drop(error), failed


def coverage(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row: the total and how many rows pass each check."""
    return df.agg(
        F.count("*").alias("total"), *[F.count_if(ok).alias(name) for name, ok in checks.items()]
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Counts per group, largest first, ties by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def reconcile_counts(df: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Expected against actual rows per key; keys that are not expected are left out.

    ``expected`` has the key and ``expected``; a key expected 0 times is skipped.
    """
    actual = df.groupBy(key).agg(F.count("*").alias("actual"))
    want = expected.filter(F.col("expected") > 0)
    return (
        want.join(actual, key, "left")
        .withColumn("actual", F.coalesce("actual", F.lit(0)))
        .withColumn("short", F.col("actual") < F.col("expected"))
    )


def completeness(required: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """One row: ids wanted, done, not yet done, done without need, and whether the sets agree."""
    want = required.select(key).distinct().withColumn("wanted", F.lit(True))
    done = finished.select(key).distinct().withColumn("done", F.lit(True))
    both = want.join(done, key, "full_outer")
    return both.agg(
        F.count_if(F.col("wanted").isNotNull()).alias("wanted"),
        F.count_if(F.col("done").isNotNull()).alias("done"),
        F.count_if(F.col("done").isNull()).alias("open"),
        F.count_if(F.col("wanted").isNull()).alias("extra"),
    ).withColumn("complete", (F.col("open") == 0) & (F.col("extra") == 0))
