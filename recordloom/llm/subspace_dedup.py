"""Near copies among vectors by a range join in cells and a subspace.

Unit vectors with a cosine of at least c are no further apart than sqrt(2 - 2c). They are rotated, so
that no direction of the data lies in one place, and their space is parted among centres: a vector
lives in the cell of its nearest centre and visits those later cells whose nearest border is within
the range. The vectors of a cell travel together, as chunks; a chunk is written once, with the list
of the cells that some of its vectors visit, and meets their chunks where both are read. So disk
holds every vector a fixed number of times, however many cells it visits.

Where two chunks meet, the squared distance in a subspace, the first few rotated dimensions, is at most the
whole one: pairs that are beyond the range there are left out, the others are verified on the whole
vectors, in the same task. Tasks return counts per vector and a spanning star per group of links, never pairs.

A ``Space`` may also be cut into blocks of a few dimensions, of which every close pair has one within its
proportional share of the range. That takes cells, and copies of the vectors, for every block; links use one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.components import components
from recordloom.llm.registry import query
from recordloom.llm.shared import join_counted, keep, read
from recordloom.llm.vectors import centres_of, matrix, not_zero, sample, squared_distances, usable

BLOCK_DIMS = 16
#: Vectors that live in a cell, about, and the most cells of a block.
CELL = 16_384
MOST_CELLS = 256
#: Bytes of vectors that are placed together.
CHUNK_BYTES = 256_000
#: Bytes of vectors, in double precision, of a chunk at most; larger cells are dealt to several.
PART_BYTES = 16_000_000
#: Pairs of chunks that go to Python at once, and files of chunks, about: as many on either side of their join.
MEETINGS, FILES = 2, 24
#: Chunks a task holds ready beside the two that meet.
HELD = 4
#: Bits of a vector's number within its part.
PLACE_BITS = 36
#: What rounding may add to squared distances of unit vectors, also in single precision, and to distances from borders.
SLACK = 1e-5
#: Squared distances from two centres that are nearer to each other than this are taken again, step by step.
TIE = 1e-9
#: Rows on either side of a tile of pairs, and pairs, that are looked at together inside a task.
TILE, PAIRS = (1_024, 512), 20_000
#: Looking at one pair in full costs as much as so many dimensions of a pair in a tile; a tile with more than one pair in DENSE is taken in full.
PAIR_DIMS, DENSE = 3_000, 32


class Space:
    """The rotation, the blocks, their budgets and their cells, for vectors of one length."""

    def __init__(self, some: np.ndarray, similarity: float, cells: int, dims: int = BLOCK_DIMS):
        width = some.shape[1]
        self.similarity = similarity
        self.turn = np.linalg.qr(np.random.default_rng(width).normal(size=(width, width)))[0]
        self.blocks = [slice(a, min(a + dims, width)) for a in range(0, width, dims)]
        self.budgets = [(2 - 2 * similarity) * (b.stop - b.start) / width * (1 + 1e-9) for b in self.blocks]
        turned = unit(some) @ self.turn
        self.centres = [centres_of(turned[:, b], cells) for b in self.blocks]
        self.slack = SLACK + width * float(np.finfo(np.float32).eps)
        self.few = few_dims(turned, sum(self.budgets))

    def homes(self, units: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
        """The cell of block ``k`` that each row lives in; equal rows live in one cell, whatever rows are beside them.

        Where squared distances ``far`` are tied but for rounding, every step is one rounding, the same in every task.
        """
        home, (block, centres) = far.argmin(1), (self.blocks[k], self.centres[k])
        if len(centres) > 1:
            two = np.partition(far, 1, axis=1)
            tied = np.flatnonzero(two[:, 1] - two[:, 0] <= TIE)
            turned, squared = np.zeros((len(tied), units.shape[1])), np.zeros((len(tied), len(centres)))
            for d in range(units.shape[1]):
                turned += units[tied, d, None] * self.turn[d]
            for i, d in enumerate(range(block.start, block.stop)):
                apart = turned[:, d, None] - centres[:, i]
                squared += apart * apart
            home[tied] = squared.argmin(1)
        return home

    def cells(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, places, home) of all cells that some of the vectors live in or visit. Cells count through all blocks."""
        units = unit(x)
        turned = units @ self.turn
        for k, (block, budget, centres) in enumerate(zip(self.blocks, self.budgets, self.centres)):
            far = squared_distances(turned[:, block], centres)
            home = self.homes(units, far, k)
            apart = np.sqrt(np.sum((centres[:, None] - centres[None]) ** 2, axis=2))
            np.fill_diagonal(apart, np.inf)
            reach = budget**0.5 + SLACK
            for c in range(home.min(initial=len(centres)), len(centres)):
                # the border between c and another centre is so far on the other side, for those who live before c
                border = ((far[:, c, None] - far) / (2 * apart[c])).max(1)
                there = np.flatnonzero((home == c) | ((home < c) & (border <= reach)))
                if len(there):
                    yield k * MOST_CELLS + c, there, home[there] == c

    def first_block(self, difference: np.ndarray) -> np.ndarray:
        """The first block within its budget for each row, or -1. Every step is one rounding, the same in every task."""
        turned = np.zeros_like(difference)
        for d in range(difference.shape[1]):
            turned += difference[:, d, None] * self.turn[d]
        first = np.full(len(difference), -1)
        for k in range(len(self.blocks) - 1, -1, -1):
            squared = np.zeros(len(difference))
            for d in range(self.blocks[k].start, self.blocks[k].stop):
                squared += turned[:, d] * turned[:, d]
            first[squared <= self.budgets[k]] = k
        return first


def few_dims(turned: np.ndarray, budget: float) -> int:
    """How many leading dimensions to compare first, from what it costs on pairs of a sample. Any number finds the same links."""
    one, two, width = turned[:1_000], turned[-1_000:], turned.shape[1]
    squared, costs = np.zeros((len(one), len(two))), {}
    for a in range(0, width, 8):
        squared += squared_distances(one[:, a : a + 8], two[:, a : a + 8])
        costs[min(a + 8, width)] = min(a + 8, width) + PAIR_DIMS * np.mean(squared <= budget)
    return min(costs, key=costs.get)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; first scaled by a power of two, so that squares neither overflow nor vanish."""
    x = x / np.exp2(np.frexp(np.abs(x).max(1))[1])[:, None]
    squared = np.zeros(len(x))
    for d in range(x.shape[1]):
        squared += x[:, d] * x[:, d]
    return x / np.sqrt(squared)[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x and the same row of y. Rows are scaled by powers of two first, which changes no digit."""
    x, y = (v / np.exp2(np.frexp(np.abs(v).max(1))[1])[:, None] for v in (x, y))
    dots, one, two = np.zeros((3, len(x)))
    for d in range(x.shape[1]):
        dots += x[:, d] * y[:, d]
        one += x[:, d] * x[:, d]
        two += y[:, d] * y[:, d]
    return dots / (np.sqrt(one) * np.sqrt(two))


class _Links:
    """Counts and linked parts of the vectors of one task."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.counts = weights, np.zeros(len(weights), np.int64)
        self.label = np.arange(len(weights))

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.counts, p, self.weights[q])
        np.add.at(self.counts, q, self.weights[p])
        while True:
            one, two = self.label[p], self.label[q]
            fresh = one != two
            if not fresh.any():
                return
            p, q, one, two = p[fresh], q[fresh], one[fresh], two[fresh]
            np.minimum.at(self.label, np.maximum(one, two), np.minimum(one, two))
            while not np.array_equal(self.label, further := self.label[self.label]):
                self.label = further


class _Chunk:
    """The vectors of a chunk as they are, and as turned unit vectors in single precision."""

    def __init__(self, space: Space, first: int, weights: np.ndarray, x: np.ndarray):
        self.first, self.weights, self.x = first, weights, x
        self.short, turn = np.empty(x.shape, np.float32), space.turn.astype(np.float32)
        for a in range(0, len(x), PAIRS):  # whole rows in double precision are made for some at a time only
            units = x[a : a + PAIRS].astype(float)
            if x.dtype == np.float32:  # squares of these neither overflow nor vanish in double precision
                units /= np.sqrt(np.einsum("nd,nd->n", units, units))[:, None]
            else:
                units = unit(units)
            np.matmul(units.astype(np.float32), turn, out=self.short[a : a + PAIRS])
        self.few = self.short[:, : space.few]
        self.squares, self.one = (self.few * self.few).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)


def _true(flags: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` flags that are set, of which there are few; there are 64 flags behind them, which are ignored."""
    some = flags[: n + -n % 64].view(np.uint64) != 0
    eights = np.flatnonzero(some.view(np.uint64))
    eights = (8 * eights[:, None] + np.arange(8))[some.reshape(-1, 8)[eights]]
    places = (8 * eights[:, None] + np.arange(8))[flags[: n + -n % 64].reshape(-1, 8)[eights]]
    return places[places < n]


def _close_pairs(space: Space, here: _Chunk, there: _Chunk) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (in ``here``, in ``there``) and cosines in single precision of pairs that may be within the range, tile by tile.

    Within one chunk a pair comes once.
    """
    left = np.hstack([-2 * here.few, here.squares - np.float32(sum(space.budgets) + space.slack), here.one])
    right = np.hstack([there.few, there.one, there.squares])
    right = {b: np.ascontiguousarray(right[b : b + TILE[1]].T) for b in range(0, len(right), TILE[1])}
    squared, close = np.empty(TILE[0] * TILE[1], np.float32), np.zeros(TILE[0] * TILE[1] + 64, bool)
    for a in range(0, len(left), TILE[0]):
        few: list[tuple[np.ndarray, np.ndarray]] = []
        for b in [b for b in right if here is not there or b + TILE[1] > a]:
            rows, others = left[a : a + TILE[0]], right[b].shape[1]
            n = len(rows) * others
            np.matmul(rows, right[b], out=squared[:n].reshape(len(rows), others))
            np.less_equal(squared[:n], 0, out=close[:n])
            p, q = np.divmod(_true(close, n), others)
            if here is there:
                p, q = p[q + b > p + a], q[q + b > p + a]
            if len(p) * DENSE > n:
                yield p + a, q + b, (here.short[a : a + TILE[0]] @ there.short[b : b + TILE[1]].T)[p, q]
            else:
                few.append((p + a, q + b))
        p, q = map(np.concatenate, zip(*few)) if few else ((), ())
        for c in range(0, len(p), PAIRS):
            i, j = p[c : c + PAIRS], q[c : c + PAIRS]
            yield i, j, np.einsum("nd,nd->n", here.short[i], there.short[j])


def _link(space: Space, here: _Chunk, there: _Chunk) -> _Links:
    """Links of one chunk with another, whose vectors are numbered behind its own, or with itself."""
    same = here is there
    found = _Links(here.weights if same else np.concatenate([here.weights, there.weights]))
    for p, q, near in _close_pairs(space, here, there):
        maybe = near >= space.similarity - space.slack
        if not maybe.any():
            continue
        p, q, near = p[maybe], q[maybe], near[maybe]
        close = near >= space.similarity + space.slack
        unsure = np.flatnonzero(~close)
        for a in range(0, len(unsure), PAIRS):
            at = unsure[a : a + PAIRS]
            close[at] = cosines(here.x[p[at]].astype(float), there.x[q[at]].astype(float)) >= space.similarity
        found.add(p[close], q[close] + (0 if same else len(here.weights)))
    return found


@contextmanager
def _few_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows at most go to Python, for rows that hold a chunk each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _starts(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by two hashes, and where in it new ones begin."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    return order, np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))


def _chunks(rows: DataFrame, width: int, space: Space, broadcast, shares: np.ndarray, first_part: int) -> tuple[DataFrame, int]:
    """A row per chunk of the distinct vectors of one length, every vector shuffled and written once; the next part's number.

    first is the number of its first vector, visits lists later cells, weights and x are packed,
    member_class and member_id list the ids of every vector. Parts of cells begin at number ``first_part``.
    """
    kind = np.dtype(np.float32 if dict(rows.dtypes)["vector"] == "array<float>" else np.float64)
    id_type = dict(rows.dtypes)["vec_id"]
    chunk, part_rows = max(1, CHUNK_BYTES // (4 * width)), max(1, PART_BYTES // (8 * width))
    parts = np.maximum(1, np.ceil(shares / part_rows)).astype(np.int64)
    begins = np.cumsum(parts) - parts

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                some = batch.slice(a, chunk)
                one, two = (some.column(c).to_numpy() for c in ("one", "two"))
                order, starts = _starts(one, two)
                ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), some.column("vec_id").take(pa.array(order)))
                one, two, x = one[order[starts]], two[order[starts]], matrix(some.column("vector"))[order[starts]]
                units, here = unit(x), broadcast.value
                home = here.homes(units, squared_distances(units @ here.turn, here.centres[0]), 0)
                part = begins[home] + (one.view(np.uint64) % parts[home].astype(np.uint64)).astype(np.int64)
                packed = x.astype(kind)
                at = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (width * kind.itemsize))
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, at, pa.py_buffer(packed.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(one), pa.array(two), ids, packed], ["part", "one", "two", "ids", "x"])

    def pack(table: pa.Table) -> pa.Table:
        part, space = table.column("part")[0].as_py(), broadcast.value
        cell = int(np.searchsorted(begins, part, "right")) - 1
        order, starts = _starts(*(table.column(c).to_numpy() for c in ("one", "two")))
        x = np.frombuffer(b"".join(table.column("x").take(pa.array(order[starts])).to_pylist()), kind).reshape(len(starts), width)
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        ids = table.column("ids").combine_chunks()
        members = pa.table({"class": place_of[pc.list_parent_indices(ids).to_numpy()], "id": ids.flatten()})
        members = members.group_by(["class", "id"]).aggregate([]).sort_by("class")
        own = members.column("class").to_numpy()
        weights = np.bincount(own, minlength=len(starts)).astype(np.int64)
        out = []
        for a in range(0, len(x), part_rows):
            b = min(a + part_rows, len(x))
            visits = {int(c) for s in range(a, b, chunk) for c, _, home in space.cells(x[s : min(s + chunk, b)].astype(float)) if not home.all()}
            mine = slice(*np.searchsorted(own, [a, b]))
            first = (first_part + part) << PLACE_BITS
            out.append((first + a, cell, sorted(visits), weights[a:b].tobytes(), x[a:b].tobytes(), own[mine] + first, members.column("id").combine_chunks()[mine]))
        first, cells, visits, weights, x, classes, ids = zip(*out)
        lists = lambda v: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, v)]), pa.int32()), pa.concat_arrays([pa.array(a) for a in v]))
        columns = [pa.array(first, pa.int64()), pa.array(cells, pa.int32()), pa.array(visits, pa.list_(pa.int32())), pa.array(weights, pa.binary()), pa.array(x, pa.binary())]
        return pa.Table.from_arrays([*columns, lists(classes), lists(ids)], ["first", "cell", "visits", "weights", "x", "member_class", "member_id"])

    placed = rows.select("one", "two", "vec_id", "vector").mapInArrow(place, f"part long, one long, two long, ids array<{id_type}>, x binary")
    schema = f"first long, cell int, visits array<int>, weights binary, x binary, member_class array<long>, member_id array<{id_type}>"
    files = min(int(parts.sum()), max(FILES, -(-int(shares.sum()) * width * kind.itemsize // (4 * PART_BYTES))))
    chunks = placed.repartition(files, "part").groupBy("part").applyInArrow(pack, schema)
    return keep(chunks, "subspace-chunks"), first_part + int(parts.sum())


def _links(chunks: DataFrame, width: int, kind: np.dtype, broadcast) -> DataFrame:
    """class, n, root: weights of links, and a star per linked part, of each pair of chunks that meet."""

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, here = broadcast.value, None
        held: dict[int, _Chunk] = {}  # the first chunks that others meet; a task meets them again and again
        for batch in batches:
            for i in range(batch.num_rows):
                def chunk(first, weights, x):
                    # copies, as what is held must not hold whole batches
                    weights, x = (np.frombuffer(batch.column(c)[i].as_buffer(), t).copy() for c, t in ((weights, np.int64), (x, kind)))
                    return _Chunk(space, first, weights, x.reshape(-1, width))

                first, other = (batch.column(c)[i].as_py() for c in ("first", "other_first"))
                if here is None or here.first != first:
                    here = chunk(first, "weights", "x")
                there = here if first == other else held.get(other) or chunk(other, "other_weights", "other_x")
                if len(held) < HELD:
                    held[other] = there
                found = _link(space, here, there)
                some = np.flatnonzero(found.counts)
                numbers = np.concatenate([first + np.arange(len(here.weights)), other + np.arange(len(there.weights) * (first != other))])
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (numbers[some], found.counts[some], numbers[found.label[some]])], ["class", "n", "root"])

    ours = chunks.select("first", "cell", "visits", "weights", "x")
    others = chunks.select(F.col("first").alias("other_first"), F.col("cell").alias("other_cell"), F.col("weights").alias("other_weights"), F.col("x").alias("other_x"))
    meet = (F.col("first") <= F.col("other_first")) & ((F.col("cell") == F.col("other_cell")) | F.array_contains("visits", F.col("other_cell")))
    # every chunk is read where it meets others; nothing is shuffled or copied to disk
    pairs = ours.join(others.hint("shuffle_replicate_nl"), meet).select("first", "weights", "x", "other_first", "other_weights", "other_x")
    with _few_at_once(chunks.sparkSession, MEETINGS):
        return keep(pairs.mapInArrow(link, "class long, n long, root long"), "subspace-links")


def near_vectors(vectors: DataFrame, similarity: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of ``similarity`` (above 0) or more, in double precision, are linked;
    n_links counts a vector's links, component_id is the smallest vec_id that links lead to, and
    the vector with that id is kept. Vectors that are null, empty, zero, or hold null or
    non-finite components are linked with nothing and kept, as are rows without id, whose
    component is null. Rows that repeat id and vector are one vector; equal vectors with different
    ids are linked, and compared with others once. Vectors of different lengths are not linked;
    each length is a pass of its own. Vectors with the same two 64-bit hashes are taken as equal.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    fine = usable(F.col("vector")) & not_zero(F.col("vector")) & F.col("vec_id").isNotNull()
    counts = rows.groupBy(F.when(fine, F.size("vector")).alias("width")).count().collect()  # a number per length
    linkable = {r["width"]: r["count"] for r in counts if r["width"] is not None and r["count"] > 1}
    alone = None
    if len(linkable) < max(len(counts), 1):  # else there are no such rows to look for
        alone = rows.filter(~fine | ~F.size("vector").isin(list(linkable))).distinct()
        alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    hashes = [F.xxhash64(F.lit(i), "vector").alias(name) for i, name in enumerate(("one", "two"))]
    rows = rows.filter(fine).select("vec_id", "vector", *hashes)
    kind = np.dtype(np.float32 if dict(rows.dtypes)["vector"] == "array<float>" else np.float64)
    part, members, found = 0, None, None
    for width, count in sorted(linkable.items()):
        same = rows.filter(F.size("vector") == width)
        some = sample(same, "vec_id")
        space = Space(some, similarity, min(MOST_CELLS, max(1, -(-count // CELL))), width)
        units = unit(some)
        home = space.homes(units, squared_distances(units @ space.turn, space.centres[0]), 0)
        shares = np.bincount(home, minlength=len(space.centres[0])) * (count / len(some))
        broadcast = vectors.sparkSession.sparkContext.broadcast(space)
        chunks, part = _chunks(same, width, space, broadcast, shares, part)
        links = _links(chunks, width, kind, broadcast)
        ids = chunks.select(F.explode(F.arrays_zip("member_class", "member_id")).alias("m"))
        ids = ids.select(F.col("m.member_class").alias("class"), F.col("m.member_id").alias("vec_id"))
        members, found = (ids, links) if found is None else (members.unionAll(ids), found.unionAll(links))
    if found is not None:
        classes = members.groupBy("class").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
        per_class = found.groupBy("class").agg(F.sum("n").alias("links"))
        ends = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")), "subspace-found")
        named = classes.join(per_class, "class", "left").join(ends, F.col("class") == F.col("node"), "left")
        named = named.filter("links is not null or n > 1")  # the others are their own component
        named = keep(named.select("class", "first_id", "n", "links", F.coalesce("root", "class").alias("root")), "subspace-named")
        least = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size"))
        named = join_counted(named, least, ["root"], "size", ["class"])
        labels = named.select("class", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
        linked = join_counted(members, keep(labels, "subspace-labels"), ["class"], "n", ["vec_id"], "left")
        linked = linked.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        alone = linked if alone is None else linked.unionAll(alone)
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query(
    "op12_subspace_dedup",
    """
    with recursive v as (
      select vec_id, embedding::double[] as x, len(embedding) as width from embeddings
      where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
        and len(list_filter(embedding, lambda c: c <> 0)) > 0),
    links as (
      select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and a.width = b.width
      where list_cosine_similarity(a.x, b.x) >= 0.9),
    reach as (
      select vec_id as a, vec_id as b from embeddings
      union
      select reach.a, links.b from reach join links on reach.b = links.a),
    least as (select a as vec_id, min(b) as component_id from reach group by all),
    n as (select a as vec_id, count(*) as n from links group by all)
    select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
    from least left join n using (vec_id)
    """,
)
def op12_subspace_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(read(spark, folder, "embeddings"))
