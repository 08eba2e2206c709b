"""Repeated stretches of words wherever they lie, inside lines, across them or both.

Two equal windows of ``min_words`` words choose the same run of GRAM words in them (the one with the
smallest hash), so only windows whose chosen run occurs twice can be repeated. Windows that follow
each other and choose the same run are one segment; equal segments are found by their hashes, and
windows are compared one by one only where a run is in segments that differ.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.registry import query
from recordloom.llm.shared import join_counted, keep, read, short_batches, small
from recordloom.llm.unit_dedup import BATCH_ROWS

#: Words of the shortest stretch that is found.
STRETCH_WORDS = 50
GRAM = 20
#: Words whose hash a task remembers, beside those of one text.
KNOWN_WORDS = 50_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = re.compile("[^\x20\x09-\x0d]+")


class _Hashes(dict):
    """16 bytes for every word."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = digest = hashlib.blake2b(word, digest_size=16).digest()
        return digest

    def of(self, text: str) -> np.ndarray:
        """Two 64-bit hashes of every word, A-Z in lower case."""
        if len(self) > KNOWN_WORDS:
            self.clear()
        words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII space parts
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8").reshape(-1, 2)


def _sums(words: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over the words, and what scales a difference of them to its first word."""
    powers, inverse = (np.cumprod(np.full(len(words), b, np.uint64)) for b in (base, pow(base, -1, 2**64)))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers)]), inverse


def _rolled(words: np.ndarray, base: int, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words."""
    sums, inverse = _sums(words, base)
    return (sums[width:] - sums[:-width]) * inverse[: len(words) - width + 1]


def chosen_runs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``min_words`` words the place of the run it chooses; the hashes of all runs."""
    gram = min(GRAM, min_words)
    runs = _rolled(words[:, 0], BASES[0], gram)
    mixed = (runs ^ (runs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    inside = np.lib.stride_tricks.sliding_window_view(mixed, min_words - gram + 1)
    return inside.argmin(axis=1) + np.arange(len(inside)), mixed


def _batches(columns: Iterable[list], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Parts of columns of one text each, as record batches."""
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        whole = [pa.array(np.concatenate(c)) if isinstance(c[0], np.ndarray) else pa.concat_arrays(c) for c in zip(*held)]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, (_, t) in zip(whole, fields)], [name for name, _ in fields])

    for part in columns:
        held.append(part)
        n += len(part[0])
        if n >= BATCH_ROWS:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def _segments(rows: DataFrame, min_words: int) -> DataFrame:
    """Windows that follow each other and choose the same run, as one row: how many, their first and last characters.

    ``head`` is where the first window ends; ``run`` and ``body`` are hashes of the run and of all words.
    """
    kind = dict(rows.dtypes)["doc_id"]
    long, int_ = pa.int64(), pa.int32()

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()

        def parts(batch: pa.RecordBatch) -> Iterator[list]:
            ids = batch.column("doc_id")
            for at, (number, value) in enumerate(zip(batch.column("number").to_pylist(), batch.column("text"))):
                words = known.of(text := value.as_py())
                if len(words) < min_words:
                    continue
                chosen, runs = chosen_runs(words, min_words)
                places, i, n = np.unique(chosen, return_index=True, return_counts=True)
                sums, inverse = _sums(words[:, 1], BASES[1])
                body = ((sums[i + n + min_words - 1] - sums[i]) * inverse[i]).view(np.int64)
                spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
                ends = spans[:, 1]
                own = ids.take(pa.array(np.full(len(i), at)))
                yield [np.full(len(i), number), own, i, n, spans[i, 0], ends[i + min_words - 1], ends[i + n + min_words - 2], runs[places].view(np.int64), body]

        for batch in batches:
            types = [long, batch.schema.field("doc_id").type, int_, int_, int_, int_, int_, long, long]
            yield from _batches(parts(batch), list(zip(["number", "doc_id", "i", "n", "start", "head", "end", "run", "body"], types)))

    columns = f"number long, doc_id {kind}, i int, n int, start int, head int, end int, run long, body long"
    return short_batches(rows).mapInArrow(make, columns)


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """Every window of the segments in ``open`` (i, n, size), with its first and last character and two hashes."""
    kind = dict(rows.dtypes)["doc_id"]
    long, int_ = pa.int64(), pa.int32()

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()

        def parts(batch: pa.RecordBatch) -> Iterator[list]:
            ids = batch.column("doc_id")
            for at, (number, value, segments) in enumerate(zip(batch.column("number").to_pylist(), batch.column("text"), batch.column("open"))):
                words = known.of(text := value.as_py())
                segment, n, size = (segments.values.field(k).to_numpy() for k in ("i", "n", "size"))
                begin = np.repeat(segment, n)
                i = begin + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
                one, two = (_rolled(words[:, k], BASES[k], min_words)[i].view(np.int64) for k in (0, 1))
                own = ids.take(pa.array(np.full(len(i), at)))
                yield [np.full(len(i), number), own, begin, i, np.repeat(size, n), spans[i, 0], spans[i + min_words - 1, 1], one, two]

        for batch in batches:
            types = [long, batch.schema.field("doc_id").type, int_, int_, long, int_, int_, long, long]
            yield from _batches(parts(batch), list(zip(["number", "doc_id", "segment", "i", "size", "start", "end", "one", "two"], types)))

    columns = f"number long, doc_id {kind}, segment int, i int, size long, start int, end int, one long, two long"
    return short_batches(rows).mapInArrow(make, columns)


def _first(*also: str) -> Column:
    """What stays of equal rows: the smallest id, null last, then the smallest place."""
    return F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "start", "number", "i", *also)).alias("first")


def repeated_stretches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = STRETCH_WORDS) -> DataFrame:
    """The stretches to remove: doc_id, start, end, words, keep_id, keep_start, keep_end, copies.

    A window of ``min_words`` words is repeated when its words are, A-Z in lower case, in the same
    document or another. Of equal windows the one with the smallest doc_id, then the smallest
    start, stays; a null id comes last. Those that do not stay and follow each other word by word
    make one row; rows of a document overlap only where a window that stays parts them. ``keep_*`` is
    where its first window stays and ``copies`` the most that a window of it has.

    Equal segments are one class, and a class is all of its run's windows unless the run is in
    several; only of those, windows are laid out, once a class. Rows may repeat ids; they are
    numbered, written with the numbers.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = keep(rows.filter(F.col("text").isNotNull()), "stretch-rows")
    segments = keep(_segments(rows, min_words), "stretch-segments")
    often = keep(segments.groupBy("run").agg(F.count("*").alias("often")).filter("often > 1"), "stretch-often")
    segments = keep(join_counted(segments, often, ["run"], "often", ["number", "i"]).drop("often"), "stretch-repeated")
    same = ["run", "body", "n"]
    classes = segments.groupBy(*same).agg(F.count("*").alias("size"), _first("head"))
    classes = keep(classes.select(*same, "size", *[F.col(f"first.{c}").alias(f"of_{c}") for c in ("doc_id", "number", "i", "start", "head")]), "stretch-classes")
    several = keep(classes.groupBy("run").agg(F.count("*").alias("several")).filter("several > 1"), "stretch-several")
    open_ = join_counted(classes, several, ["run"], "several", ["of_number", "of_i"])
    open_ = open_.groupBy(F.col("of_number").alias("number")).agg(F.collect_list(F.struct(F.col("of_i").alias("i"), "n", "size")).alias("open"))
    open_ = keep(open_, "stretch-open")
    texts = rows.join(small(open_.select("number")), "number", "left_semi")
    windows = keep(_windows(texts.join(open_, "number"), min_words), "stretch-windows")
    first = windows.groupBy("one", "two").agg(F.count("*").alias("met"), F.sum("size").alias("copies"), _first("end"))
    first = first.select("one", "two", "met", "copies", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "start", "end", "number", "i")])
    windows = keep(join_counted(windows, keep(first, "stretch-first"), ["one", "two"], "met", ["number", "i"]), "stretch-known")
    kept = [F.col(f"first_{c}").alias(f"keep_{k}") for c, k in (("doc_id", "id"), ("start", "start"), ("end", "end"))]
    columns = ["number", "doc_id", "i", "n", "start", "end", "keep_id", "keep_start", "keep_end", "copies"]
    alone = windows.filter("number != first_number or i != first_i").select("*", F.lit(1).alias("n"), *kept).select(columns)
    # the other members of a class are repeated throughout; their first windows stay where those of the class do
    heads = windows.groupBy(F.col("number").alias("of_number"), F.col("segment").alias("of_i")).agg(
        F.max("copies").alias("copies"), F.min_by(F.struct(*kept), "i").alias("head_of")
    )
    stays = F.coalesce("head_of", F.struct(F.col("of_doc_id").alias("keep_id"), F.col("of_start").alias("keep_start"), F.col("of_head").alias("keep_end")))
    classes = classes.filter("size > 1").join(heads, ["of_number", "of_i"], "left")
    classes = classes.select(*same, "size", "of_number", "of_i", stays.alias("stays"), F.coalesce("copies", "size").alias("copies"))
    members = join_counted(segments, keep(classes, "stretch-kept"), same, "size", ["number", "i"])
    members = members.filter("number != of_number or i != of_i").select("*", "stays.*").select(columns)
    # a document's rows only, which its length bounds
    place = Window.partitionBy("number").orderBy("i")
    begins = F.coalesce(F.lag(F.col("i") + F.col("n")).over(place) != F.col("i"), F.lit(True)).cast("int")
    moved = members.unionAll(alone).withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(place))
    found = moved.groupBy("number", "stretch").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.sum("n") + min_words - 1).cast("int").alias("words"),
        *[F.min_by(c, "i").alias(c) for c in ("keep_id", "keep_start", "keep_end")],
        F.max("copies").alias("copies"),
    )
    return found.drop("number", "stretch")


@query(
    "op3_stretch_dedup",
    """
    with tokens as (
      select doc_id, unnest(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+')) as token,
        generate_subscripts(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+'), 1) as i
      from documents),
    words as (
      select doc_id, i, regexp_extract(translate(
          token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as said,
        cast(sum(length(token)) over (partition by doc_id order by i) as integer) as "end"
      from tokens),
    whole as (
      select doc_id, list(said order by i) as says, list("end" - length(said) order by i) as starts, list("end" order by i) as ends
      from words group by doc_id),
    windows as (
      select doc_id, i, cast(starts[i] as integer) as start, ends[i + 49] as "end", md5(array_to_string(says[i:i + 49], ' ')) as said
      from (select *, unnest(range(1, len(says) - 48)) as i from whole)),
    ranked as (
      select doc_id, i, start, "end", row_number() over w as n, count(*) over (partition by said) as copies,
        first_value(doc_id) over w as keep_id, first_value(start) over w as keep_start, first_value("end") over w as keep_end
      from windows window w as (partition by said order by doc_id, start)),
    moved as (select *, i - row_number() over (partition by doc_id order by i) as stretch from ranked where n > 1)
    select doc_id, min(start) as start, max("end") as "end", cast(count(*) + 49 as integer) as words,
      arg_min(keep_id, i) as keep_id, arg_min(keep_start, i) as keep_start, arg_min(keep_end, i) as keep_end, max(copies) as copies
    from moved group by doc_id, stretch
    """,
)
def op3_stretch_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated stretches of 50 words or more, also those inside lines, which ``op3_line_dedup`` does not see."""
    return repeated_stretches(read(spark, folder, "documents"))
