"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The model says P(grade > k) = logistic(w.x - cut_k): one set of weights for all ordered cuts.
Features are words and word beginnings; those that mark toxic rows are chosen by a grouped
count, and their values are the log of one plus their number in the text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.registry import query
from recordloom.llm.shared import keep, read, short_batches

#: Bounds of what is fitted on: about so many labelled rows, chosen by a hash of their ids ...
SAMPLE_ROWS = 20_000
#: ... and at most so many features, the strongest of those that are in enough graded rows.
MAX_FEATURES = 4_096
MIN_ROWS = 5
MIN_LOG_ODDS = 1.5
#: Word beginnings of these lengths are features beside whole words.
HEADS = (4, 5, 6)
EDGES = ".,;:!?\"'()[]{}<>*-_"
REJECT = 0.5
BATCH = 512


def features(text: str | None, known: dict[str, int] | None = None) -> Counter:
    """How often each feature is in a text; only those in ``known``, by its numbers, if given."""
    found: Counter = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        word = word.strip(EDGES)
        names = [f"={word}"] + [word[:k] for k in HEADS if len(word) >= k]
        for name in names:
            if known is None:
                found[name] += n
            elif (at := known.get(name)) is not None:
                found[at] += n
    return found


@dataclass
class OrdinalModel:
    """Weights of the features and the ordered cuts between grades 0, 1, 2, ..."""

    names: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for every cut k."""
        score = sum(self.weights[at] * math.log1p(n) for at, n in features(text, self.names).items())
        return 1 / (1 + np.exp(-np.clip(score - self.cuts, -500, 500)))


def fit_cumulative(
    rows: list[tuple[int, dict[int, float]]], n_features: int, grades: int, l2: float = 0.1, steps: int = 600
) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of P(y > k) = logistic(w.x - cut_k) with a penalty on w; (weights, cuts).

    Cuts are kept in order as a first cut and positive distances. Adam on all rows at once,
    from a fixed start, so the fit is the same each time.
    """
    y = np.array([g for g, _ in rows])
    at = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    column = np.array([c for _, x in rows for c in x], int)
    value = np.array([v for _, x in rows for v in x.values()], float)
    share = np.array([(y > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    first, gaps = start[:1], np.log(np.maximum(np.diff(start), 0.1))
    p = np.concatenate([np.zeros(n_features), first, gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, cuts = p[:n_features], np.cumsum(np.concatenate([p[n_features : n_features + 1], np.exp(p[n_features + 1 :])]))
        score = np.bincount(at, value * w[column], len(rows))
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        low, high = edge[y] - score, edge[y + 1] - score
        upper, lower = 1 / (1 + np.exp(-high.clip(-40, 40))), 1 / (1 + np.exp(-low.clip(-40, 40)))
        upper[y == grades - 1], lower[y == 0] = 1.0, 0.0
        mass = np.maximum(upper - lower, 1e-12)
        d_high, d_low = upper * (1 - upper) / mass, -lower * (1 - lower) / mass
        by_score = d_high + d_low  # of the negative log likelihood
        g_w = np.bincount(column, value * by_score[at], n_features) + l2 * w
        g_cut = np.array([-(d_high[y == k].sum() + d_low[y == k + 1].sum()) for k in range(grades - 1)])
        g_tail = g_cut[::-1].cumsum()[::-1]
        g = np.concatenate([g_w, g_tail[:1], g_tail[1:] * np.exp(p[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_features], np.cumsum(np.concatenate([p[n_features : n_features + 1], np.exp(p[n_features + 1 :])]))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of about ``rows`` labelled documents at most, chosen by a hash of the id.

    Null ids and labels are left out; of several labels of one id the highest counts, and of
    several texts one.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
    known = keep(known.agg((F.max("toxic") > 0).cast("int").alias("toxic")), "toxic-labels")
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about ``rows`` rows
    return keep(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxic-sample")


def _count_features(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):  # a count holds the words of so many texts at most
            part, rows = batch.slice(start, BATCH), Counter()
            for toxic, text in zip(part.column("toxic").to_pylist(), part.column("text").to_pylist()):
                rows.update((name, toxic) for name in features(text))
            names, toxic = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(toxic, pa.int32()), pa.array(rows.values(), pa.int64())],
                ["name", "toxic", "rows"],
            )


def choose_features(sample: DataFrame, most: int = MAX_FEATURES) -> dict[str, int]:
    """Features that mark toxic rows: in enough of them, and by far more often than in others."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {}
    counts = short_batches(sample).mapInArrow(_count_features, "name string, toxic int, rows long")
    per = counts.groupBy("name").agg(*[F.sum(F.when(F.col("toxic") == t, F.col("rows")).otherwise(0)).alias(f"in_{t}") for t in (0, 1)])
    odds = {t: F.log((F.col(f"in_{t}") + 0.5) / (sizes[t] - F.col(f"in_{t}") + 0.5)) for t in (0, 1)}
    sure = F.sqrt(1 / (F.col("in_1") + 0.5) + 1 / (F.col("in_0") + 0.5))
    strong = per.filter(F.col("in_1") >= MIN_ROWS).withColumn("odds", odds[1] - odds[0] - 2 * sure)
    strong = strong.filter(F.col("odds") >= MIN_LOG_ODDS).orderBy(F.desc("odds"), "name").limit(most)
    return {r["name"]: i for i, r in enumerate(strong.select("name").collect())}


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = MAX_FEATURES) -> OrdinalModel:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic 0/1).

    The labels know two grades. Toxic rows are parted into grade 1 and 2 at the median of
    their number of marking words, so that grades follow how much of it a text holds. Without
    rows of both labels nothing marks toxicity and no text is graded above 0.
    """
    sample = labelled_sample(docs, labels, rows)
    names = choose_features(sample, most)
    if not names:
        return OrdinalModel({}, np.zeros(0), np.array([20.0, 21.0]))

    def marked(batches):
        for batch in batches:
            found = [features(t, names) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([list(f) for f in found], pa.list_(pa.int32())),
                 pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "at", "n"],
            )

    # at most the sample's rows, each with the few chosen features that it holds
    got = short_batches(sample).mapInArrow(marked, "doc_id long, toxic int, at array<int>, n array<int>").collect()
    got.sort(key=lambda r: r["doc_id"])
    middle = np.median([sum(r["n"]) for r in got if r["toxic"]])
    rows_ = [
        (r["toxic"] * (1 + (sum(r["n"]) > middle)), {a: math.log1p(n) for a, n in zip(r["at"], r["n"])}) for r in got
    ]
    grades = max(g for g, _ in rows_) + 1
    weights, cuts = fit_cumulative(rows_, len(names), grades)
    return OrdinalModel(names, weights, cuts)


def grade_toxicity(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, severity (expected grade), grade (the median of the model), p_toxic, toxic.

    ``severity`` is the sum of P(grade > k) over the cuts; ``toxic`` is P(grade > 0) at or above
    one half. Null texts count as empty; the whole text is read, whatever its length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_FEATURES

    def rows(batches):
        model = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                above = np.array([model.above(t.as_py()) for t in part.column("text")])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1), pa.int32()),
                     pa.array(above[:, 0]), pa.array(above[:, 0] >= REJECT)],
                    ["doc_id", "severity", "grade", "p_toxic", "toxic"],
                )

    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return short_batches(named).mapInArrow(rows, f"doc_id {dict(named.dtypes)['doc_id']}, severity double, grade int, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not ``toxic`` by their own text, whatever their ids."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_FEATURES

    def rows(batches):
        model = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                yield part.filter(pa.array([bool(model.above(t.as_py())[0] < REJECT) for t in part.column(text)], pa.bool_()))

    return short_batches(docs).mapInArrow(rows, docs.schema)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return grade_toxicity(docs, fit_toxicity(docs, read(spark, folder, "labels")))
