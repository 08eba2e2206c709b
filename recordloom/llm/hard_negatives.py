"""Hard negatives by an inverted multi-index.

Vectors are cut in halves, each half has a codebook, and a pair of codes is a cell. A cell cannot hold
a higher inner product with an anchor than the sum of its two half bounds: the anchor's half
times the centre, plus the length of the anchor's half times the radius of the code. A heap over the two
sorted lists of half bounds (the multi-sequence walk) gives an anchor its cells from the highest
sum down. It may stop as soon as the next sum is below what it still needs, which certifies the
result: for positives the last score of a full list, for negatives the lower end of the windows
or the last score of full windows.

The walk goes in rounds, all anchors in one plan: the cells of a first quota of rows, then all cells
that the scores found so far do not rule out. Rows and anchors meet by first code, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.registry import query
from recordloom.llm.shared import keep, read
from recordloom.llm.vectors import centres_of, lengths, matrix, sample, squared_distances, usable

#: The most codes of a half. There are about as many as the fourth root of the rows, so cells hold about their square root.
MOST_CODES = 64
#: Rows in the cells of an anchor's first round; where it finds too few, the next rounds have GROW times as many.
QUOTA, GROW = 2_048, 8
#: Rows of a code, and anchors, that meet in one group; more are dealt to blocks.
ROW_BLOCK, ANCHOR_BLOCK = 4_096, 512
#: Anchors scored at once inside a group.
STEP = 64
#: Scores are whole numbers; beyond this they are cut, so that a hundred times a score is a long.
MOST_SCORE = 9 * 10**16


class Book:
    """Two codebooks with the radii of their codes, and the rows of each cell."""

    def __init__(self, some: np.ndarray, codes: int):
        cut = (some.shape[1] + 1) // 2
        self.halves = (slice(0, cut), slice(cut, some.shape[1]))
        self.centres = [centres_of(some[:, h], codes) for h in self.halves]
        self.radii = [np.zeros(len(c)) for c in self.centres]
        self.rows = np.zeros([len(c) for c in self.centres], np.int64)

    def codes(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the nearest code of each row, and the distance from it."""
        out = []
        for h, centres in zip(self.halves, self.centres):
            near = squared_distances(x[:, h], centres).argmin(1)
            out.append((near, np.sqrt(((x[:, h] - centres[near]) ** 2).sum(1))))
        return out

    def bounds(self, anchor: np.ndarray) -> list[np.ndarray]:
        """For each half what no half score of a code's rows exceeds; a little more, for rounding."""
        out = []
        for h, centres, radii in zip(self.halves, self.centres, self.radii):
            length = np.sqrt((anchor[h] ** 2).sum())
            size = length * (np.sqrt((centres**2).sum(1)) + radii)
            out.append(centres @ anchor[h] + length * radii + 1e-9 * size + 1e-3)
        return out


def cells_in_order(bounds: list[np.ndarray]) -> Iterator[tuple[float, int, int]]:
    """(bound, first code, second code) of all cells, highest bound first, by a heap over both sorted lists."""
    one, two = (np.argsort(-b, kind="stable") for b in bounds)
    a, b = bounds[0][one], bounds[1][two]
    heap, reached = [(-(a[0] + b[0]), 0, 0)], np.zeros(len(a), np.int64)  # of each row of the grid how many cells are pushed
    reached[0] = 1
    while heap:
        least, p, q = heapq.heappop(heap)
        yield -least, int(one[p]), int(two[q])
        if q + 1 < len(b) and reached[p] == q + 1 and (p == 0 or reached[p - 1] > q + 1):
            heapq.heappush(heap, (-(a[p] + b[q + 1]), p, q + 1))
            reached[p] = q + 2
        if p + 1 < len(a) and reached[p + 1] == q:
            heapq.heappush(heap, (-(a[p + 1] + b[q]), p + 1, q))
            reached[p + 1] = q + 1


def _next_cells(book: Book, anchor: np.ndarray, seen: int, floor: float | None, quota: int | None) -> tuple[dict[int, list[int]], int, bool]:
    """The cells an anchor visits next, by first code; how many it has then seen; whether no other can matter.

    It goes on while the next bound reaches ``floor``, and while the cells of this round hold fewer rows than ``quota``.
    """
    visits: dict[int, list[int]] = {}
    rows = 0
    for at, (bound, i, j) in enumerate(cells_in_order(book.bounds(anchor))):
        if floor is not None and bound < floor:
            return visits, at, True
        if at < seen:
            continue
        if quota is not None and rows >= quota:
            return visits, at, False
        if book.rows[i, j]:
            visits.setdefault(i, []).append(j)
            rows += int(book.rows[i, j])
    return visits, book.rows.size, True


STATE = "row long, label long, x binary, seen int, done boolean, visits array<struct<i:int,js:array<int>>>, tops array<long>"


def _plan(state: DataFrame, book, name: str) -> DataFrame:
    """``state`` (row, label, x, seen, floor, quota, tops) one round on: visits of this round, seen and done after it."""

    def plan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("x", "seen", "floor", "quota")}
            planned = [_next_cells(book.value, np.frombuffer(x, float), *rest) for x, *rest in zip(*columns.values())]
            visits = [[{"i": i, "js": js} for i, js in v.items()] for v, _, _ in planned]
            kind = pa.list_(pa.struct([("i", pa.int32()), ("js", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("label"), batch.column("x"), pa.array([s for _, s, _ in planned], pa.int32()),
                 pa.array([d for _, _, d in planned], pa.bool_()), pa.array(visits, kind), batch.column("tops")],
                ["row", "label", "x", "seen", "done", "visits", "tops"],
            )

    columns = ("row", "label", "x", "seen", "floor", "quota", "tops")
    # the walk is work for the processor: few rows each
    return keep(state.select(*columns).repartition("row").mapInArrow(plan, STATE), name)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _meet(entries: DataFrame, planned: DataFrame, book, width: int, k: int, window: tuple[int, int] | None) -> DataFrame:
    """row (the anchor's), top, other, vec_id, score: the first ``k`` of each visited block.

    Without ``window`` of the anchor's own label (top is 0); with it, of other labels, for each of ``tops``
    those from window[0] to window[1] per cent of it.
    """
    codes = len(book.value.centres[1])
    visits = planned.select("row", "label", "x", "tops", F.explode("visits").alias("v")).select("row", "label", "x", "tops", "v.i", "v.js")
    visits = keep(visits, "negatives-visits")
    counts = visits.groupBy("i").agg(F.ceil(F.count("*") / ANCHOR_BLOCK).cast("int").alias("parts"))
    blocks = [(i, int(-(-n // ROW_BLOCK))) for i, n in enumerate(book.value.rows.sum(1))]
    counts = counts.join(entries.sparkSession.createDataFrame(blocks, "i int, blocks int"), "i")
    counts = F.broadcast(keep(counts, "negatives-parts"))  # a row per first code
    zero = F.lit(0)
    left = entries.join(counts, "i").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1))).drop("blocks", "parts")
    right = visits.join(counts, "i").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1))).drop("blocks", "parts")
    names = ["row", "top", "other", "vec_id", "score"]

    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            x, q = (np.frombuffer(b"".join(t.column("x").to_pylist()), float).reshape(t.num_rows, width) for t in (rows, anchors))
            own, ids, labels, js = (rows.column(n).to_numpy() for n in ("row", "vec_id", "label", "j"))
            asked, wanted, tops = anchors.column("row").to_numpy(), anchors.column("label").to_numpy(), anchors.column("tops").to_pylist()
            open_ = np.zeros((len(q), codes), bool)
            for a, cells in enumerate(anchors.column("js").to_pylist()):
                open_[a, cells] = True
            for at in range(0, len(q), STEP):
                scores = np.clip(q[at : at + STEP] @ x.T, -MOST_SCORE, MOST_SCORE).astype(np.int64)
                for a in range(at, min(at + STEP, len(q))):
                    score = scores[a - at]
                    there = open_[a, js] & (own != asked[a])
                    there &= (labels == wanted[a]) == (window is None)
                    for top in [0] if window is None else tops[a]:
                        here = there if window is None else there & (100 * score >= window[0] * top) & (100 * score <= window[1] * top)
                        here = np.flatnonzero(here)
                        here = here[_first(score[here], ids[here], k)]
                        if len(here):
                            found.append((np.full(len(here), asked[a]), np.full(len(here), top), own[here], ids[here], score[here]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    keys = ["i", "block", "part"]
    left = left.select(*keys, "row", "vec_id", "label", "x", "j").groupBy(*keys)
    right = right.select(*keys, "row", "label", "x", "js", "tops").groupBy(*keys)
    return left.cogroup(right).applyInArrow(meet, ", ".join(f"{n} long" for n in names))


def _best(found: DataFrame, k: int, name: str) -> DataFrame:
    order = Window.partitionBy("row", "top").orderBy(F.desc("score"), "vec_id", "other")
    return keep(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), name)


def _mine(vectors: DataFrame, width: int, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    """The result for the rows of one length: row, vec_id, label, vector, anchor."""
    spark = vectors.sparkSession
    rows = vectors.count()
    book = Book(sample(vectors, "vec_id"), min(MOST_CODES, max(1, round(rows**0.25))))
    sent = spark.sparkContext.broadcast(book)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                x = matrix(part.column("vector"))
                (i, far_i), (j, far_j) = sent.value.codes(x)
                columns = [part.column(n) for n in ("row", "vec_id", "label", "anchor")]
                columns += [pa.array([v.tobytes() for v in x], pa.binary()), *map(pa.array, (i.astype(np.int32), j.astype(np.int32), far_i, far_j))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "label", "anchor", "x", "i", "j", "far_i", "far_j"])

    schema = "row long, vec_id long, label long, anchor boolean, x binary, i int, j int, far_i double, far_j double"
    entries = keep(vectors.mapInArrow(code, schema), "negatives-entries")
    for half, (c, far) in enumerate((("i", "far_i"), ("j", "far_j"))):
        for r in entries.groupBy(c).agg(F.max(far).alias("radius")).collect():  # a row per code
            book.radii[half][r[c]] = r["radius"]
    for r in entries.groupBy("i", "j").count().collect():  # a row per cell: at most MOST_CODES squared
        book.rows[r["i"], r["j"]] = r["count"]
    sent.unpersist()
    sent = spark.sparkContext.broadcast(book)

    none = F.lit(None)
    anchors = entries.filter("anchor").select("row", "vec_id", "label", "x")
    state = anchors.select("row", "label", "x", F.lit(0).alias("seen"), F.array().cast("array<long>").alias("tops"))
    best, quota = spark.createDataFrame([], "row long, top long, other long, vec_id long, score long, rank int"), QUOTA
    while True:  # rounds: the quota grows GROW-fold, and a full list needs one round more
        floors = best.groupBy("row").agg(F.when(F.count("*") >= positives, F.min("score")).cast("double").alias("floor"))
        state = state.join(floors, "row", "left").withColumn("quota", F.when(F.col("floor").isNull(), F.lit(quota)))
        state = _plan(state, sent, "positives-plan")
        found = _meet(entries, state, sent, width, positives, None)
        best = _best(best.drop("rank").unionAll(found), positives, "positives-best")
        state = state.filter("not done").drop("visits", "done")
        if state.isEmpty():
            break
        quota *= GROW

    own = best.select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # a window below a negative score is empty
    tops = own.filter("positive_score >= 0").groupBy("row").agg(F.array_sort(F.collect_set("positive_score")).alias("tops"))  # at most ``positives``
    low = F.col("tops")[0].cast("double") * window[0] / 100 - 1e-3
    state = anchors.join(tops, "row").select("row", "label", "x", F.lit(0).alias("seen"), "tops", low.alias("floor"), F.lit(QUOTA).alias("quota"))
    state = _plan(state, sent, "negatives-plan")
    best = _best(_meet(entries, state, sent, width, negatives, window), negatives, "negatives-best")
    state = state.filter("not done").drop("visits", "done")
    if not state.isEmpty():
        full = best.groupBy("row", "top").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("last"))
        floors = state.select("row", F.explode("tops").alias("top")).join(full, ["row", "top"], "left")
        needed = F.greatest(F.col("top") * F.lit(window[0]) / 100 - 1e-3, F.when(F.col("n") >= negatives, F.col("last")))
        floors = floors.groupBy("row").agg(F.min(needed).alias("floor"))
        state = _plan(state.join(floors, "row").withColumn("quota", none.cast("int")), sent, "negatives-plan")
        found = _meet(entries, state, sent, width, negatives, window)
        best = _best(best.drop("rank").unionAll(found), negatives, "negatives-best")

    mined = own.join(best, (own["row"] == best["row"]) & (own["positive_score"] == best["top"])).drop(best["row"])
    mined = mined.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return mined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100),
    vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The score of two rows is their inner product; components must be whole numbers, and scores
    are exact below 2**53. The positives of a row for which ``anchor`` holds are its ``positives`` best
    other rows of the same label. For each, its negatives are the ``negatives`` best rows of other
    labels whose scores are from window[0] to window[1] per cent of the positive's. Ties go to the
    smaller vec_id; where there are fewer, all count.

    Rows without vec_id or label take no part, nor do vectors that are null, empty, or hold null or
    non-finite components. Rows that repeat vec_id, label and vector are one; rows that share only
    a vec_id are others to each other. Labels are whole numbers. Vectors of different lengths have
    no score; each length is mined on its own.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    rows = rows.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).distinct()
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")  # numbers are fixed once written
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for width in lengths(rows, 2):
        same = rows.filter(F.size("vector") == width)
        if not same.filter("anchor").isEmpty():
            out = out.unionAll(_mine(same, width, positives, negatives, window))
    return out


@query(
    "op11_hard_negatives",
    """
    with v as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, len(embedding) as width,
        list_transform(embedding, lambda c: floor(256 * c::double)) as x
      from embeddings
      where vec_id is not null and label is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
    s as (
      select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id and a.width = b.width where a.vec_id % 100 = 0),
    p as (
      select anchor_id, other as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
    select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other)::int as rank,
      other as negative_id, positive_score, score as negative_score
    from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
    qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, other) <= 5
    """,
)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    # what is not finite stays so, for floor would make it a number
    whole = F.when(usable(F.col("embedding")), whole)
    return hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("embedding")), F.col("vec_id") % 100 == 0)
