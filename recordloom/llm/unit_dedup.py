"""Substring dedup by hashing of lines or paragraphs.

Every unit of text is normalised and hashed; digests are grouped over the whole corpus, the
occurrence that ranks first stays, and all others are removed. Spans refer to the original
text, so a removal can be shown, undone or compared with the copy that stays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.registry import ORACLES, query
from recordloom.llm.shared import join_counted, keep, read, row_key, short_batches

#: What parts units: an end of line, or one followed by an empty line.
BREAKS = {"line": re.compile("\n"), "paragraph": re.compile("\n[ \t\r]*\n\\s*")}
#: Shorter units repeat by chance (headings, notices, menus) and are left alone.
MIN_WORDS = 20
BATCH_ROWS = 20_000


def units_of(text: str | None, unit: str = "line") -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of every unit that has words; places count characters."""
    start, text = 0, text or ""
    ends = [(m.start(), m.end()) for m in BREAKS[unit].finditer(text)] + [(len(text), len(text))]
    for end, onward in ends:
        words = text[start:end].encode().lower().split()  # bytes: only A-Z change, only ASCII space parts
        if words:
            yield start, end, len(words), hashlib.sha256(b" ".join(words)).digest()[:16]
        start = onward


def passages_of(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the shortest runs of lines with ``min_words`` words, from and up to every line.

    Lines without words do not count. Whatever its line lengths, a passage of so many words is
    covered by those of its runs that lie inside it: up to its last line, and from those before.
    """
    lines = list(units_of(text))
    sums = [0, *accumulate(n for _, _, n, _ in lines)]
    runs = set()
    for i in range(len(lines)):
        if (j := bisect_left(sums, sums[i] + min_words, i + 1)) <= len(lines):
            runs.add((i, j))
        if sums[i + 1] >= min_words:
            runs.add((bisect_right(sums, sums[i + 1] - min_words, 0, i + 1) - 1, i + 1))
    for i, j in sorted(runs):
        digest = hashlib.sha256(b"".join(line[3] for line in lines[i:j])).digest()[:16]
        yield lines[i][0], lines[j - 1][1], sums[j] - sums[i], digest


def text_units(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id, start, end, words and digest of every unit; nothing for null and empty texts.

    Units are lines, paragraphs or, as ``passage``, runs of lines of ``min_words`` words, which overlap.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "words", "digest"]
        types = [None, pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            types[0] = batch.schema.field("doc_id").type
            held: list[tuple] = []
            for i, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                units = passages_of(value.as_py(), min_words) if unit == "passage" else units_of(value.as_py(), unit)
                held += [(i, *u) for u in units]
                if len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(named.dtypes)["doc_id"]
    return short_batches(named).mapInArrow(rows, f"doc_id {kind}, start int, end int, words int, digest binary")


def repeated_units(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = MIN_WORDS
) -> DataFrame:
    """The spans to remove: doc_id, start, end, words, keep_id, keep_start, keep_end, copies.

    Units are equal when their words are, A-Z in lower case. Of equal units with ``min_words``
    words or more, the one with the smallest doc_id, then the smallest start, stays (``keep_*``);
    a null id comes last. Every other one is a row, in the same document or another. ``copies``
    counts all. Rows that repeat an id and a text are equal units at one place, of which one
    stays and the others are rows.

    With ``unit="passage"`` a repeated passage of short lines gives spans too; they may overlap,
    and every line in one of them stays in another place.
    """
    units = keep(text_units(docs, doc_id, text, unit, min_words).filter(F.col("words") >= min_words), "unit-digests")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "start", "end")
    first = units.groupBy("digest").agg(F.count("*").alias("copies"), F.min(rank).alias("first"))
    first = first.filter("copies > 1").select(
        "digest", "copies", F.col("first.doc_id").alias("keep_id"), F.col("first.start").alias("keep_start"), F.col("first.end").alias("keep_end")
    )
    first = keep(first, "unit-first")
    again = join_counted(units, first, ["digest"], "copies", ["doc_id", "start"])
    there = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("start") == F.col("keep_start"))
    columns = ["doc_id", "start", "end", "words", "keep_id", "keep_start", "keep_end", "copies"]
    moved = again.filter(~there).select(columns)
    # rows that repeat an id and text: all but one of those at the place that stays
    twice = again.filter(there).groupBy(columns).count().filter("count > 1")
    return moved.unionAll(twice.select(*columns, F.explode(F.sequence(F.lit(2).cast("long"), "count")).alias("_")).drop("_"))


def _cut(value: str | None, spans: list[dict] | None) -> str | None:
    if not spans or value is None:
        return value
    out, at = [], 0
    for s in spans:
        out.append(value[at : s["start"]])
        at = max(at, s["end"] + (value[s["end"] : s["end"] + 1] == "\n"))
    return "".join([*out, value[at:]])


def without_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the characters of ``spans`` (doc_id, start, end), and the break after each.

    Spans name rows by their ids, null included, which must not repeat where there are spans;
    for other tables there is ``without_repeats``.
    """
    per = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    per = keep(per.withColumnRenamed("doc_id", "id"), "unit-cuts")
    rows = short_batches(docs).select(F.struct(*docs.columns).alias("doc"))
    own = F.col("doc").getField(doc_id)
    ids = docs.select(F.col(doc_id).alias("doc_id")).groupBy("doc_id").count().filter("count > 1")
    if not ids.join(per, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").isEmpty():
        raise ValueError("ids repeat, so spans do not tell their rows: use without_repeats")
    joined = rows.join(per, own.eqNullSafe(F.col("id")), "left")

    @F.arrow_udf("string")
    def cut(values: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_cut(value.as_py(), own) for value, own in zip(values, spans.to_pylist())], pa.string())

    whole = cut(F.col("doc").getField(text), F.col("spans"))
    return joined.select(*[(whole if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "passage", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` without their repeated units: every row is cut at its own, one copy stays in the corpus.

    Ids may be null or repeat. Rows are named by ``row_key`` and a number, written with them.
    """
    key = F.struct(row_key(docs, doc_id).alias("row"), F.monotonically_increasing_id().alias("number"))
    name = max(docs.columns, key=len) + "_"  # longer than any column's name, so none of them
    keyed = keep(docs.withColumn(name, key), "unit-rows")
    return without_spans(keyed, repeated_units(keyed, name, text, unit, min_words), name, text).select(*docs.columns)


@query(
    "op3_line_dedup",
    """
    with lines as (
      select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
      from documents),
    placed as (
      select doc_id, place, line, cast(coalesce(sum(length(line) + 1) over (
        partition by doc_id order by place rows between unbounded preceding and 1 preceding), 0) as integer) as start
      from lines),
    worded as (
      select doc_id, start, cast(start + length(line) as integer) as "end",
        regexp_extract_all(translate(
          line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as said
      from placed),
    units as (
      select doc_id, start, "end", array_to_string(said, ' ') as said, len(said) as words,
        row_number() over w as i, cast(sum(len(said)) over w as bigint) as upto
      from worded where len(said) > 0 window w as (partition by doc_id order by start)),
    whole as (select doc_id, list(said order by i) as says, list(start order by i) as starts, list("end" order by i) as ends, list(upto order by i) as sums
      from units group by doc_id),
    runs as (
      select a.doc_id, a.i as i, b.i as j from units a asof join units b on a.doc_id = b.doc_id and a.upto - a.words + 20 <= b.upto
      union
      select a.doc_id, b.i as i, a.i as j from (select *, upto - 20 as least from units) a
        asof join (select *, upto - words as before from units) b on a.doc_id = b.doc_id and a.least >= b.before),
    passages as (
      select doc_id, starts[i] as start, ends[j] as "end", array_to_string(says[i:j], chr(10)) as said,
        cast(sums[j] - case when i > 1 then sums[i - 1] else 0 end as integer) as words
      from runs join whole using (doc_id)),
    ranked as (
      select doc_id, start, "end", words,
        row_number() over w as n, count(*) over (partition by said) as copies,
        first_value(doc_id) over w as keep_id, first_value(start) over w as keep_start, first_value("end") over w as keep_end
      from passages window w as (partition by said order by doc_id, start))
    select doc_id, start, "end", words, keep_id, keep_start, keep_end, copies from ranked where n > 1
    """,
)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated runs of lines: a line of enough words alone, shorter ones together with their neighbours."""
    return repeated_units(read(spark, folder, "documents"), unit="passage")


@query(
    "op3_long_line_dedup",
    """
    with lines as (
      select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
      from documents),
    placed as (
      select doc_id, place, line, cast(coalesce(sum(length(line) + 1) over (
        partition by doc_id order by place rows between unbounded preceding and 1 preceding), 0) as integer) as start
      from lines),
    units as (
      select doc_id, start, cast(start + length(line) as integer) as "end",
        array_to_string(regexp_extract_all(translate(
          line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') as said,
        cast(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as integer) as words
      from placed),
    ranked as (
      select doc_id, start, "end", words,
        row_number() over w as n, count(*) over (partition by said) as copies,
        first_value(doc_id) over w as keep_id, first_value(start) over w as keep_start, first_value("end") over w as keep_end
      from units where words >= 20 window w as (partition by said order by doc_id, start))
    select doc_id, start, "end", words, keep_id, keep_start, keep_end, copies from ranked where n > 1
    """,
)
def op3_long_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The same for lone lines only."""
    return repeated_units(read(spark, folder, "documents"))


@query("op3_passage_dedup", ORACLES["op3_line_dedup"])
def op3_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The earlier name of ``op3_line_dedup``."""
    return op3_line_dedup(spark, folder)
