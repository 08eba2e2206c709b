"""Approximate nearest neighbours by a permutation index.

A vector is the list of its nearest pivots, nearest first. It is posted in the inverted files of
the first POSTED of them. A query reads the files of its own nearest pivots, ranks what it finds
there by the footrule distance of the two lists, over its nearest pivots, and compares the better
part by the vectors themselves.

Pivots grow with the square root of the vectors, so files hold about its multiple, and the part of
the files that is read and the part of a file that is compared both fall.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.registry import query
from recordloom.llm.shared import keep, read
from recordloom.llm.vectors import lengths, matrix, not_zero, sample, usable

#: The fewest and the most pivots; between them the square root of the number of vectors.
PIVOTS = (32, 1_024)
#: Files a vector is posted in; the most pivots of its list that are kept.
POSTED, LISTED = 8, 64
#: A query reads so many times the square root of the number of pivots, as files ...
READ = 2.0
#: ... ranks what is there by the places of so many of its nearest pivots, or of those it reads if more ...
RANKED = 32
#: ... and compares those within a distance that this many by the number of pivots, as a share of a
#: sample of vectors, are in for that query, but no more than MOST_COMPARED.
COMPARED, MOST_COMPARED = 32, 0.75
#: Entries of an inverted file, and queries, that meet in one group; more are dealt to blocks.
FILE_BLOCK = 4_096
QUERY_BLOCK = 512


def choose_pivots(vectors: DataFrame, rows: int) -> np.ndarray:
    """Distinct vectors of the first by a hash of vec_id, as many as ``rows`` vectors need; the same for every run."""
    wanted = min(PIVOTS[1], max(PIVOTS[0], round(rows**0.5)))
    some = np.unique(sample(vectors, "vec_id", 2 * wanted), axis=0)
    return some[np.random.default_rng(3).permutation(len(some))[:wanted]]


def _nearest_pivots(x: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    p = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    return np.argsort(-(x @ p.T), axis=1, kind="stable").astype(np.uint16)[:, :listed]


def _places(orders: np.ndarray, pivots: int) -> np.ndarray:
    """Where each pivot (row) is on each list (column); those not on a list come after it."""
    n, listed = orders.shape
    place = np.full((pivots, n), listed, np.int16)
    place[orders.T, np.arange(n)] = np.arange(listed, dtype=np.int16)[:, None]
    return place


def _footrule(places: np.ndarray) -> np.ndarray:
    """Footrule distances of lists, given where they have a query's first, second, ... pivot."""
    return np.abs(places - np.arange(len(places), dtype=np.int16)[:, None]).sum(0, dtype=np.int32)


def with_pivots(vectors: DataFrame, pivots: np.ndarray, first: int, reach: tuple[np.ndarray, int, float] | None = None) -> DataFrame:
    """vec_id, the packed vector, ``order`` (its nearest pivots, nearest first, two bytes each), the ``first`` of them, cut.

    With ``reach``, (a sample of vectors, pivots to rank by, share), ``cut`` is the footrule distance
    that this share of the sample is within.
    """
    sent = vectors.sparkSession.sparkContext.broadcast((pivots, reach))  # PIVOTS[1] and SAMPLE vectors at most
    listed = max(LISTED, first)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, reach = sent.value
        others = None if reach is None else _places(_nearest_pivots(reach[0], pivots, listed), len(pivots))
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                x = matrix(part.column("vector"))
                order = _nearest_pivots(x, pivots, listed)
                cut = np.zeros(len(x), np.int32)
                if reach is not None:
                    cut[:] = [np.quantile(_footrule(others[o[: reach[1]]]), reach[2]) for o in order]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary()),
                     pa.array([o.tobytes() for o in order], pa.binary()),
                     pa.array([o[:first].tolist() for o in order], pa.list_(pa.int32())), pa.array(cut)],
                    ["vec_id", "vector", "order", "pivots", "cut"],
                )

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.mapInArrow(rows, f"vec_id {kind}, vector binary, order binary, pivots array<int>, cut int")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), float).reshape(len(ids), -1)
    orders = np.frombuffer(b"".join(table.column("order").to_pylist()), np.uint16).reshape(len(ids), -1)
    return ids, vectors, orders


def _search(entries: pa.Table, queries: pa.Table, pivots: int, posted: int, ranked: int, k: int) -> Iterator[tuple]:
    """Per query its id, and ids and scores of its ``k`` nearest in one block of one pivot's file."""
    pivot = entries.column("pivot")[0].as_py()
    ids, x, orders = _unpacked(entries.sort_by("vec_id"))
    asked, q, asked_orders = _unpacked(queries)
    place, cuts = _places(orders, pivots), queries.column("cut").to_numpy()
    near: list[np.ndarray] = []
    for at in range(len(asked)):
        mine = place[asked_orders[at, :ranked]]  # where the entries have the query's first, second, ... pivot
        rank = int(np.flatnonzero(asked_orders[at] == pivot)[0])
        # an entry that an earlier pivot's file also has is met there
        there = np.flatnonzero((mine[:rank] >= posted).all(0) & (ids != asked[at]))
        foot = _footrule(mine[:, there])
        some = there[foot <= cuts[at]]
        if len(some) < k < len(there):
            some = there[np.argpartition(foot, k)[:k]]
        elif len(some) < k:
            some = there
        score = x[some] @ q[at]
        if len(some) > k:  # a little more than the best, for rounding
            last = np.partition(score, len(some) - k)[len(some) - k]
            some = some[score >= last - 1e-9 * max(1.0, np.abs(score).max())]
        near.append(some)
    one, two = np.repeat(np.arange(len(asked)), [len(some) for some in near]), np.concatenate([*near, np.zeros(0, int)]).astype(int)
    score = np.zeros(len(one))
    for d in range(x.shape[1]):  # in this order for every pair, so equal vectors have equal scores
        score += q[one, d] * x[two, d]
    bounds = np.cumsum([0, *(len(some) for some in near)])
    for at, (a, b) in enumerate(zip(bounds, bounds[1:])):
        best = a + first_k(score[a:b], ids[two[a:b]], k)
        yield asked[at], ids[two[best]], score[best]


def first_k(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query its ``k`` nearest found: query_id, rank, vec_id, score (inner product, in double).

    Every usable vector of ``vectors`` is posted; ``queries`` has the same columns, and a query
    does not find its own id. Vectors that are null, empty, zero, or hold null or non-finite
    components take no part on either side, nor do rows without id. Of an id that repeats with
    one vector one row counts. Ties go to the smaller id. Vectors of different lengths have no
    inner product: every length has an index of its own, and a query searches that of its length.

    A file and its queries meet in blocks of bounded size, however many there are of either,
    and each block passes on ``k`` rows per query at most. A pair that shares several files is
    compared once, in the first that the query reads.
    """
    parts = []
    for df in (vectors, queries):
        fine = df.filter(usable(F.col(vector)) & not_zero(F.col(vector)) & F.col(vec_id).isNotNull())
        parts.append(fine.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).distinct())
    base, wanted = keep(parts[0], "index-base"), parts[1]
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in lengths(base):
        same = [df.filter(F.size("vector") == width) for df in (base, wanted)]
        found = found.unionAll(_nearest(*same, k))
    return found


def _nearest(base: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``nearest_vectors`` for distinct (vec_id, vector) of one length."""
    centres = choose_pivots(base, base.count())
    posted, n_pivots = min(POSTED, len(centres)), len(centres)
    reading = min(n_pivots, int(np.ceil(READ * n_pivots**0.5)))
    ranked, compared = max(RANKED, reading), min(MOST_COMPARED, COMPARED / n_pivots)
    index = keep(with_pivots(base, centres, posted), "index-vectors").withColumn("pivot", F.explode("pivots"))
    asked = keep(with_pivots(wanted, centres, reading, (sample(base, "vec_id"), ranked, compared)), "index-queries").withColumn("pivot", F.explode("pivots"))

    # how many blocks each file has: a row per pivot
    counts = index.groupBy("pivot").agg(F.count("*").alias("n"))
    counts = counts.join(asked.groupBy("pivot").agg(F.count("*").alias("m")), "pivot")
    counts = counts.select("pivot", F.ceil(F.col("n") / FILE_BLOCK).alias("blocks"), F.ceil(F.col("m") / QUERY_BLOCK).alias("parts"))
    counts = F.broadcast(keep(counts, "index-counts"))  # a row per pivot
    zero = F.lit(0).cast("long")
    entries = index.join(counts, "pivot").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")))
    entries = entries.withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1)))
    readers = asked.join(counts, "pivot").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")))
    readers = readers.withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(_search(left, right, n_pivots, posted, ranked, k)) if left.num_rows and right.num_rows else []
        names = [np.repeat(i, len(ids)) for i, ids, _ in rows], [ids for _, ids, _ in rows], [s for _, _, s in rows]
        return pa.table(
            {n: pa.array(np.concatenate(v) if v else [], t) for n, v, t in zip(("query_id", "vec_id", "score"), names, (pa.int64(), pa.int64(), pa.float64()))}
        )

    keys = ["pivot", "block", "part"]
    columns = [*keys, "vec_id", "vector", "order"]
    found = entries.select(columns).groupBy(*keys).cogroup(readers.select(*columns, "cut").groupBy(*keys))
    found = found.applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op9_permutation_index")
def op9_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return nearest_vectors(vectors, vectors.filter("vec_id % 20 = 0"))
