"""Records against statements of interest ("units"): search, re-rank, annotate, rank.

Scoring is a matrix product per Arrow batch inside the tasks, and only the best rows per
unit leave a task: pairs are never laid out as rows, and nothing is joined without a key.
Units are few in normal use and travel with the task; above ``max_units`` they are cut
into blocks and meet slices of the records by key instead. Both ways are exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import scores as S
from recordloom.functions.lists import people_text, takeaways_text
from recordloom.functions.text import clip, or_empty
from recordloom.operators.scale import small_or_shuffled, top_k
from recordloom.session import TEXT_ROWS, short_batches, work_dir

if TYPE_CHECKING:
    from recordloom.operators.vector_index import VectorIndex

SEARCH_K = 150
FINAL_K = 50
MAX_UNITS = 2_000
SLICE_ROWS = 100_000
# Hits of a search (a few numbers each) that may be broadcast to fetch their texts.
MAX_HITS = 500_000
# Scores are compared after rounding, so that equal vectors tie whatever the summation order.
DIGITS = 6
#: Words whose bucket a task remembers, beside those of one batch.
KNOWN_WORDS = 50_000


def record_text(records: DataFrame, out: str = "record_text") -> DataFrame:
    """One searchable text per detailed session: nine labelled fields joined by ' | '."""
    fields = [
        ("Title", or_empty(F.col("title"))),
        ("Topic", or_empty(F.col("topic"))),
        ("Industry", or_empty(F.col("industry"))),
        ("Abstract", clip(F.col("abstract"), 500)),
        ("Key Takeaways", clip(takeaways_text(F.col("key_takeaways")), 300)),
        ("NVIDIA Technology", or_empty(F.col("nvidia_technology"))),
        ("Speakers", people_text(F.col("speakers"))),
        ("Technical Level", or_empty(F.col("technical_level"))),
        ("Audience", or_empty(F.col("intended_audience"))),
    ]
    return records.withColumn(
        out, F.concat_ws(" | ", *[F.concat(F.lit(f"{label}: "), value) for label, value in fields])
    )


# --- vectors ------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+")


def hashed_words(dimensions: int = 256) -> Callable:
    """The built-in vectoriser: counts of words per hash bucket, as a Pandas UDF."""

    class Buckets(dict):
        def __missing__(self, word: str) -> int:
            self[word] = bucket = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimensions
            return bucket

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectorise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bucket = Buckets()
        for texts in batches:
            if len(bucket) > KNOWN_WORDS:
                bucket.clear()
            vectors = []
            for text in texts:
                words = _WORD.findall(text or "")
                places = np.fromiter(map(bucket.__getitem__, words), np.int64, len(words))
                vectors.append(np.bincount(places, minlength=dimensions).astype(np.float32))
            yield pd.Series(vectors)

    return lambda c: vectorise(F.lower(c))


def vectorise(df: DataFrame, text: str, out: str = "vector", vectoriser: Callable | None = None) -> DataFrame:
    """Add a vector per row from its text; pass any column function as ``vectoriser``."""
    return short_batches(df).withColumn(out, (vectoriser or hashed_words())(F.col(text)))


def scaled_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, norm) of every row, scaled to length one; the vector is null where it has no length.

    Nothing is filtered here: Spark would run a vectoriser once more for a filter on the norm.
    """
    norm = F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )
    scaled = F.transform(vector, lambda x: x.cast("double") / F.col("norm"))
    return df.select(key, vector).withColumn("norm", norm).select(key, F.when(F.col("norm") > 0, scaled).alias(vector), "norm")


def build_index(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, norm) scaled to length one; rows without a usable vector are left out."""
    return scaled_vectors(df, key, vector).filter("norm > 0")


def write_index(index: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write an index once, to be searched many times, and return it as read back."""
    index.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return index.sparkSession.read.parquet(path)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero."""
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(lengths > 0, lengths, 1.0)[:, None]


def _vectors(ids, column) -> tuple[np.ndarray, np.ndarray]:
    """(ids, float64 matrix) of an id and a list column, rows without a vector left out."""
    if isinstance(ids, pa.ChunkedArray):
        ids, column = ids.combine_chunks(), column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0)
    usable = pc.greater(lengths, 0)
    if not pc.all(usable).as_py():
        ids, column = ids.filter(usable), column.filter(usable)
    if not len(column):
        return np.empty(0, np.int64), np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _ids(ids), flat.reshape(len(column), -1)


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as an array that sorts like Spark does: whole numbers, or text by code point."""
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    return np.array(column.to_pylist(), dtype=str) if text else column.to_numpy(zero_copy_only=False)


def _id_type(df: DataFrame, column: str) -> str:
    """Whole-number ids are compared as such, all others as text."""
    return "long" if dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint") else "string"


_ARROW = {"long": pa.int64(), "string": pa.string()}


def _found_batch(columns: Sequence[np.ndarray], unit_type: str, key_type: str) -> list[pa.Array]:
    types = [_ARROW[unit_type], _ARROW[key_type], pa.float64()]
    return [pa.array(c.tolist(), t) for c, t in zip(columns, types)]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by the smaller id."""
    if len(scores) > k:
        # everything tied with the k-th best stays in until the exact sort
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


class _Heads:
    """The k best records per unit seen so far in one task."""

    def __init__(self, unit_ids: np.ndarray, units: np.ndarray, k: int) -> None:
        self.unit_ids, self.units, self.k = unit_ids, _unit_rows(units), k
        self.kept = [(np.empty(0, np.int64), np.empty(0)) for _ in unit_ids]

    def add(self, ids: np.ndarray, vectors: np.ndarray, only: np.ndarray | None = None) -> None:
        """Score these records, for all units or for those at the places ``only``."""
        only = np.arange(len(self.unit_ids)) if only is None else only
        scores = np.round(_unit_rows(vectors) @ self.units[only].T, DIGITS)
        best = scores.max(axis=0) if len(scores) else np.empty(0)
        for at, u in enumerate(only):
            old_ids, old_scores = self.kept[u]
            if not len(scores) or (len(old_ids) == self.k and best[at] < old_scores[-1]):
                continue  # none of these is among the best
            near = _best(ids, scores[:, at], self.k)
            both_ids = np.concatenate([old_ids, ids[near]])
            both_scores = np.concatenate([old_scores, scores[near, at]])
            places = _best(both_ids, both_scores, self.k)
            self.kept[u] = (both_ids[places], both_scores[places])

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = [len(ids) for ids, _ in self.kept]
        return (
            np.repeat(self.unit_ids, counts),
            np.concatenate([ids for ids, _ in self.kept] or [np.empty(0, np.int64)]),
            np.concatenate([s for _, s in self.kept] or [np.empty(0)]),
        )


def _small_units(units: DataFrame, unit: str, vector: str, max_units: int):
    """(ids, matrix) of the units when there are at most ``max_units`` of them, else None."""
    rows = units.select(unit, vector).limit(max_units + 1).toArrow()
    if rows.num_rows > max_units:
        return None
    ids, matrix = _vectors(rows.column(0), rows.column(1))
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix[order]


def search(
    records: DataFrame,
    units: DataFrame,
    key: str,
    unit: str,
    vector: str,
    k: int = SEARCH_K,
    max_units: int = MAX_UNITS,
) -> DataFrame:
    """(unit, key, score, rank): the k most similar records per unit by cosine, ties by key.

    Ids are whole numbers or text. Rows without a vector cannot be scored and take no part.
    """
    # vectors are not tested in a filter: Spark would run a vectoriser once more for it
    key_type, unit_type = _id_type(records, key), _id_type(units, unit)
    with_vector = short_batches(records).select(F.col(key).cast(key_type).alias("_key"), vector)
    wanted = units.select(F.col(unit).cast(unit_type).alias("_unit"), vector)
    small = _small_units(wanted, "_unit", vector, max_units)
    if small is None:
        found = _search_blocks(with_vector, wanted, vector, k, max_units, unit_type, key_type)
    else:
        found = _search_small(with_vector, small, vector, k, unit_type, key_type)
    ranked = top_k(found, ["_unit"], [F.desc("score"), F.col("_key")], k, ["_key"])
    return ranked.select(F.col("_unit").alias(unit), F.col("_key").alias(key), "score", "rank")


def _found(unit_type: str, key_type: str) -> str:
    return f"_unit {unit_type}, _key {key_type}, score double"


def _search_small(records: DataFrame, small, vector: str, k: int, unit_type: str, key_type: str) -> DataFrame:
    """Every task scores its records against all units and passes on its k best per unit."""
    unit_ids, matrix = small
    if not len(unit_ids):
        return records.sparkSession.createDataFrame([], _found(unit_type, key_type))
    shared = records.sparkSession.sparkContext.broadcast((unit_ids, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = _Heads(*shared.value, k)
        for batch in batches:
            ids, vectors = _vectors(batch.column(0), batch.column(1))
            if len(ids):
                heads.add(ids, vectors)
        columns = heads.columns()
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays(_found_batch(columns, unit_type, key_type), ["_unit", "_key", "score"])

    return records.mapInArrow(score, _found(unit_type, key_type))


def _search_blocks(
    records: DataFrame, units: DataFrame, vector: str, k: int, max_units: int, unit_type: str, key_type: str
) -> DataFrame:
    """Many units: blocks of units meet slices of records by (block, slice).

    Both sides of a meeting are bounded: about ``max_units`` units and ``SLICE_ROWS`` records.
    """
    blocks = -(-units.count() // max_units)
    slices = max(1, -(-records.count() // SLICE_ROWS))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_slice = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    left = records.withColumn("_slice", F.pmod(F.xxhash64("_key"), F.lit(slices)).cast("int"))
    left = left.withColumn("_block", every_block)
    right = units.withColumn("_block", F.pmod(F.xxhash64("_unit"), F.lit(blocks)).cast("int"))
    right = right.withColumn("_slice", every_slice)

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        unit_ids, matrix = _vectors(b.column("_unit"), b.column(vector))
        columns = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if len(unit_ids):
            heads = _Heads(unit_ids, matrix, k)
            # a slice's scores against a block are many times its vectors: they are held for TEXT_ROWS rows at a time
            for at in range(0, a.num_rows, TEXT_ROWS):
                rows = a.slice(at, TEXT_ROWS)
                ids, vectors = _vectors(rows.column("_key"), rows.column(vector))
                if len(ids):
                    heads.add(ids, vectors)
            columns = heads.columns()
        return pa.table(dict(zip(["_unit", "_key", "score"], _found_batch(columns, unit_type, key_type))))

    meet = left.groupBy("_block", "_slice").cogroup(right.groupBy("_block", "_slice"))
    return meet.applyInArrow(score, _found(unit_type, key_type))


def best_unit(
    records: DataFrame, units: DataFrame, key: str, unit: str, vector: str, max_units: int = MAX_UNITS
) -> DataFrame:
    """(key, unit, score): the unit every record fits best, ties by unit. One row per record.

    A record without a vector, or without units to fit, has a null unit and score.
    """
    # vectors are not tested in a filter: Spark would run a vectoriser once more for it
    key_type, unit_type = _id_type(records, key), _id_type(units, unit)
    with_vector = short_batches(records).select(F.col(key).cast(key_type).alias("_key"), vector)
    wanted = units.select(F.col(unit).cast(unit_type).alias("_unit"), vector)
    small = _small_units(wanted, "_unit", vector, max_units)
    if small is None:
        # seen from the other side: the records are what is searched for, one hit each
        swapped = _search_blocks(
            wanted.withColumnRenamed("_unit", "_key"), with_vector.withColumnRenamed("_key", "_unit"), vector, 1, max_units,
            key_type, unit_type,
        )
        best = swapped.groupBy("_unit").agg(F.min_by("_key", F.struct(-F.col("score"), "_key")).alias("u"), F.max("score").alias("score"))
        best = with_vector.select("_key").join(best, F.col("_key") == F.col("_unit"), "left")
        return best.select(F.col("_key").alias(key), F.col("u").alias(unit), "score")
    shared = records.sparkSession.sparkContext.broadcast(small)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_ids, matrix = shared.value
        scaled = _unit_rows(matrix).T
        for batch in batches:
            usable = pc.greater(pc.fill_null(pc.list_value_length(batch.column(1)), 0), int(not len(unit_ids)) * 2**30)
            without = batch.column(0).filter(pc.invert(usable)).to_pylist()
            units, keys, best_scores = [None] * len(without), without, [None] * len(without)
            ids, vectors = _vectors(batch.column(0).filter(usable), batch.column(1).filter(usable))
            if len(ids):
                scores = np.round(_unit_rows(vectors) @ scaled, DIGITS)
                best = scores.argmax(axis=1)
                units += unit_ids[best].tolist()
                keys += ids.tolist()
                best_scores += scores[np.arange(len(best)), best].tolist()
            types = [_ARROW[unit_type], _ARROW[key_type], pa.float64()]
            columns = [pa.array(c, t) for c, t in zip((units, keys, best_scores), types)]
            yield pa.RecordBatch.from_arrays(columns, ["_unit", "_key", "score"])

    found = with_vector.mapInArrow(score, _found(unit_type, key_type))
    return found.select(F.col("_key").alias(key), F.col("_unit").alias(unit), "score")


# --- re-rank, annotate, rank -----------------------------------------------------------------


def overlap_scorer(record: Column, unit: Column) -> Column:
    """The built-in scorer, over words: share of the unit's words found in the record."""
    return F.round(S.token_overlap(record, unit), DIGITS)


def shared_words(record: Column, unit: Column) -> Column:
    """The built-in reason, over words: those record and unit have in common."""
    return F.concat(F.lit("Shared terms: "), F.array_join(S.shared(record, unit), ", "))


def as_text(c: Column) -> Column:
    """``prepare`` for scorers and generators that read the plain texts."""
    return c


def with_contents(
    candidates: DataFrame,
    records: DataFrame,
    units: DataFrame,
    key: str,
    unit: str,
    record_text: str,
    unit_text: str,
    prepare: Callable[[Column], Column] = S.tokens,
) -> DataFrame:
    """Candidates with ``_record`` and ``_unit``: both texts, prepared once per record and unit.

    Candidates are few against the records. While they are within the broadcast bound the
    records are only filtered in passing; otherwise both sides are shuffled.
    """
    wanted = small_or_shuffled(candidates.select(key).distinct(), MAX_HITS)
    hit = records.join(wanted, key, "left_semi").select(key, prepare(F.col(record_text)).alias("_record"))
    asked = units.select(unit, prepare(F.col(unit_text)).alias("_unit"))
    return hit.join(small_or_shuffled(candidates, MAX_HITS), key).join(small_or_shuffled(asked, MAX_UNITS), unit)


def rerank(
    candidates: DataFrame,
    key: str,
    unit: str,
    k: int = FINAL_K,
    scorer: Callable[[Column, Column], Column] = overlap_scorer,
) -> DataFrame:
    """Keep the k best candidates per unit by ``scorer`` (a column function or Pandas UDF)."""
    scored = candidates.drop("rank").withColumn("rerank_score", scorer(F.col("_record"), F.col("_unit")))
    return top_k(scored, [unit], [F.desc("rerank_score"), F.desc("score"), F.col(key)], k, [key])


def annotate(
    matched: DataFrame,
    out: str = "recommendation_reason",
    generator: Callable[[Column, Column], Column] = shared_words,
) -> DataFrame:
    """Add a text per matched pair; pass a model as a Pandas UDF in ``generator``."""
    return matched.withColumn(out, generator(F.col("_record"), F.col("_unit")))


def rank_per_unit(scored: DataFrame, unit: str, score: str, key: str, k: int) -> DataFrame:
    """Ranks 1..k per unit, best score first, ties by key."""
    return top_k(scored, [unit], [F.desc(score), F.col(key)], k, [key])


def cascade(
    records: DataFrame,
    units: DataFrame,
    key: str,
    unit: str,
    record_text: str,
    unit_text: str,
    search_k: int = SEARCH_K,
    final_k: int = FINAL_K,
    vectoriser: Callable | None = None,
    prepare: Callable[[Column], Column] = S.tokens,
    scorer: Callable[[Column, Column], Column] = overlap_scorer,
    generator: Callable[[Column, Column], Column] = shared_words,
    index: VectorIndex | None = None,
) -> DataFrame:
    """All units in one plan: cheap vector search, costly scorer on its hits only, reasons, ranks.

    The hits are few (at most ``search_k`` per unit) and used twice, to fetch their texts and
    to pair them with units, so they are computed once and kept in the shared work folder. With
    ``index``, a stored index of the records' vectors by the same vectoriser, records are neither
    made into vectors again nor read in full.
    """
    u = vectorise(units.select(unit, unit_text), unit_text, "vector", vectoriser)
    if index is not None:
        hits = keep(index.search(u, unit, "vector", search_k), "hits")
    else:
        r = vectorise(records.select(key, record_text), record_text, "vector", vectoriser)
        hits = keep(search(r, u, key, unit, "vector", search_k), "hits")
    pairs = with_contents(hits, records, units, key, unit, record_text, unit_text, prepare)
    reasons = annotate(rerank(pairs, key, unit, final_k, scorer), generator=generator)
    return reasons.select(unit, key, "rank", "score", "rerank_score", "recommendation_reason")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a small intermediate result to the shared work folder and read it back."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def unit_counts(matched: DataFrame, unit: str) -> DataFrame:
    return matched.groupBy(unit).agg(F.count("*").alias("n"))
