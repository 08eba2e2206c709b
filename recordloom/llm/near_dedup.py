"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is POSITIONS minima of its shingle hashes, a byte of each, in
chunks, and each chunk bears a number of errors, chosen so that the sum of errors + 1 over the
chunks is above the greatest distance looked at. By the pigeonhole principle some chunk of two
signatures within that distance differs in no more positions than it bears: all ways to leave
out so many positions of a chunk are enumerated as keys, and the two share one of them. So
every pair within the distance meets.

What meets is first compared by signature, inside the tasks, and only the links of a spanning
forest leave a task. The groups they form are where full shingle sets are compared, again
inside the tasks and in blocks, so that no group is laid out as pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.components import components
from recordloom.llm.registry import query
from recordloom.llm.shared import join_counted, keep, read, short_batches, small

WORDS = 5
SIMILARITY = 0.8
POSITIONS = 63
#: The least distance that is looked at.
GUARANTEED = 17
#: Keys are made of so many positions, or fewer if there would be more than MAX_KEYS of them.
KEY_POSITIONS = 4
MAX_KEYS = 400
#: Rows of a bucket or group that one task compares with as many others.
BLOCK = 256
#: Shingles of such a block, about; groups of longer documents have more blocks.
BLOCK_SHINGLES = 2_000_000
#: Bytes of text that are hashed at once.
SLICE = 500_000

_M = np.uint64(0x9E3779B97F4A7C15)
_R = np.random.default_rng(7)
_MULTIPLY = _R.integers(0, 2**63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _R.integers(0, 2**63, POSITIONS, np.uint64)
_BYTE = _R.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _R.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and first bytes of the words in UTF-8 bytes; A-Z counts as a-z."""
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # a polynomial in a random odd number over random values of the bytes, by word
    place = np.arange(len(raw))
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(raw))))
    value = _BYTE[low] * _powers(int((ends - starts).max()))[np.minimum(place, (ends - starts).max() - 1)]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(inside, value, np.uint64(0)), dtype=np.uint64)])
    return _mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64)), starts


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 64), _PLACE[0])]), dtype=np.uint64)
    return _POWERS


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Per text: the sorted distinct hashes of its word n-grams; of the whole sequence if it is shorter."""
    joined = b"\n".join(texts)
    hashes, starts = word_hashes(np.frombuffer(joined, np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    run = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        run += hashes[k : len(hashes) - words + 1 + k] * _PLACE[1 + k]
    run = _mix(run)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:  # its length takes part, so it never equals a full n-gram
            whole = (hashes[a:b] * _PLACE[1 : 1 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mix(np.array([whole ^ _XOR[0]])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of POSITIONS bytes per set; empty sets have zeros."""
    out = np.zeros((len(sets), POSITIONS), np.uint8)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        every = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for p in range(POSITIONS):
            least = np.minimum.reduceat((every ^ _XOR[p]) * _MULTIPLY[p], starts)
            out[full, p] = (_mix(least) >> np.uint64(56)).astype(np.uint8)
    return out


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in pieces of bounded size, with their texts as bytes."""
    start, held, size = 0, [], 0
    for i, value in enumerate(batch.column("text")):
        text = (value.as_py() or "").encode()
        held.append(text)
        size += len(text)
        if size >= SLICE or i + 1 == batch.num_rows:
            yield batch.slice(start, i + 1 - start), held
            start, held, size = i + 1, [], 0


def _class_of(shingles: np.ndarray) -> int:
    """One number for a set: all its hashes, mixed; texts of one class have the same set."""
    mixed = _mix(shingles * _PLACE[10] + _PLACE[11]).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(_mix(np.array([mixed])).view(np.int64)[0])


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _sliced(batch):
            sets = shingle_sets(texts)
            marks = [x.tobytes() if len(s) else None for x, s in zip(signatures(sets), sets)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(marks, pa.binary())],
                ["doc_id", "mark", "n_shingles", "class", "signature"],
            )


class Forest:
    """Union-find over the nodes that a task has linked; a node is (order, id), the root of a set its first."""

    def __init__(self):
        self.up: dict[tuple, tuple] = {}

    def root(self, i: tuple) -> tuple:
        while (above := self.up.get(i, i)) != i:
            self.up[i] = self.up.get(above, above)
            i = above
        return i

    def join(self, i: tuple, j: tuple) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def stars(self) -> pa.RecordBatch:
        """(a, b): every linked node and the root of its set."""
        roots = [(i, self.root(i)) for i in self.up]
        pairs = [(i[-1], r[-1]) for i, r in roots if i != r]
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys`` in tables of whole groups, with the bounds of the groups."""

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            c = table.column(key).to_numpy()
            new |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])

    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            bounds = cut(held)
            if len(bounds) > 2:  # the last group may go on in the next batch
                yield held.slice(0, bounds[-2]), bounds[:-1]
                held = held.slice(bounds[-2])
    if held is not None:
        yield held, cut(held)


def _close_pairs(left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature matrices that differ in at most ``most`` positions, closest first."""
    if len(left) * len(right) <= 256:
        far = (left[:, None] != right[None]).sum(2)
    else:
        far = np.zeros((len(left), len(right)), np.uint8)
        for p in range(POSITIONS):
            far += left[:, p, None] != right[None, :, p]
    i, j = np.nonzero(far <= most)
    order = np.argsort(far[i, j], kind="stable")
    return i[order], j[order]


def _link_group(
    nodes: list[tuple], side: np.ndarray, marks: np.ndarray, most: int, linked: Callable | None, forest: Forest
) -> None:
    """Join in ``forest`` what is close in one group. ``side`` 0 meets 1; 2 meets its like as well."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for at in range(0, len(left), BLOCK):
        part = left[at : at + BLOCK]
        i, j = _close_pairs(marks[part], marks[right], most)
        x, y = part[i], right[j]
        while len(x):
            numbers: dict[tuple, int] = {}
            sets = np.array([numbers.setdefault(forest.root(n), len(numbers)) for n in nodes])
            apart = sets[x] != sets[y]
            x, y = x[apart], y[apart]
            now = max(1_000, len(x) // 20)  # the closest first, which often link the others too
            for p, q in zip(x[:now].tolist(), y[:now].tolist()):
                if forest.root(nodes[p]) != forest.root(nodes[q]) and (linked is None or linked(p, q)):
                    forest.join(nodes[p], nodes[q])
            x, y = x[now:], y[now:]


def _in_groups(rows: DataFrame, keys: list[str], most: int, percent: int | None, hubs: bool = False) -> DataFrame:
    """Links (a, b) found in the groups of ``rows``: spanning stars of each task, not all pairs.

    They are confirmed on full sets if ``percent`` is given. With ``hubs`` a row of side 0 or 2
    is the root of a star that has one.
    """

    def similar(shingles: pa.ChunkedArray) -> Callable:
        sets = [np.frombuffer(x, np.uint64) for x in shingles.to_pylist()]

        def linked(i, j):
            a, b = sets[i], sets[j]
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                return False
            both = len(np.intersect1d(a, b, assume_unique=True))
            return 100 * both >= percent * (len(a) + len(b) - both)

        return linked

    def work(batches):
        forest = Forest()
        for table, bounds in _whole_groups(batches, keys):
            side = table.column("side").to_numpy()
            nodes = [(int(hubs and s == 1), c) for s, c in zip(side.tolist(), table.column("class").to_pylist())]
            marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            if "root" in table.column_names:  # what is linked already needs no more links
                for node, root in zip(nodes, table.column("root").to_pylist()):
                    forest.join(node, (0, root))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if len({forest.root(x) for x in nodes[a:b]}) > 1:
                    linked = None if percent is None else similar(table.column("shingles").slice(a, b - a))
                    _link_group(nodes[a:b], side[a:b], marks[a:b], most, linked, forest)
        yield forest.stars()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "a long, b long")


def kept_positions(most: int) -> list[list[int]]:
    """The positions that each key is made of; signatures at most ``most`` positions apart share a key."""
    for size in range(KEY_POSITIONS, 0, -1):
        # as many chunks as fit: a chunk has the positions of a key and one more for each error
        fits = [n for n in range(1, POSITIONS // size + 1) if size * n + max(0, most + 1 - n) <= POSITIONS]
        if not fits:
            continue
        n = fits[-1]
        even, more = divmod(max(0, most + 1 - n), n)
        errors = [even + (c < more) for c in range(n)]
        if sum(comb(size + e, e) for e in errors) <= MAX_KEYS:
            starts = np.cumsum([0] + [size + e for e in errors]).tolist()
            return [list(stay) for a, b in zip(starts, starts[1:]) for stay in combinations(range(a, b), size)]
    return [[]]  # any two signatures meet


def index_keys(signature: Column, most: int = GUARANTEED) -> Column:
    """An array with a hash of every choice of ``kept_positions``: how two signatures meet that are ``most`` apart."""
    choices = kept_positions(most)

    @F.arrow_udf("array<bigint>")
    def keys(marks: pa.Array) -> pa.Array:
        rows = np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(-1, POSITIONS)
        places = _mix(rows.astype(np.uint64) + np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(256))
        found = np.stack([np.bitwise_xor.reduce(places[:, stay], axis=1) for stay in choices], axis=1)
        bounds = np.arange(0, found.size + 1, len(choices), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.view(np.int64).ravel()))

    return keys(signature)


def dealt_blocks(rows: DataFrame, n: Column, per_block: int = BLOCK) -> DataFrame:
    """Copy the rows of a large group to pairs of its blocks (i, j), so that any two rows meet once.

    ``side`` tells what a row meets there: 2 in the pair of a block with itself, else 0 and 1.
    """
    blocks = F.ceil(n / F.lit(per_block)).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda j: F.struct(
            F.least(own, j).alias("i"), F.greatest(own, j).alias("j"),
            F.when(own == j, 2).when(own < j, 0).otherwise(1).alias("side"),
        ),
    )
    return rows.withColumn("_pair", F.explode(pairs)).select("*", "_pair.*").drop("_pair")


def candidate_groups(classes: DataFrame, most: int) -> DataFrame:
    """(node, root): classes joined into groups by signatures at most ``most`` positions apart."""
    posted = classes.select("class", F.explode(index_keys(F.col("signature"), most)).alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keep(posted.join(shared.hint("merge"), "key"), "near-met")  # Spark cannot tell the size of exploded rows
    rows = met.join(classes.select("class", "signature"), "class")
    rows = dealt_blocks(rows, F.col("n"), 8 * BLOCK).select("key", "i", "j", "side", "class", "signature")
    return components(_in_groups(rows, ["key", "i", "j"], most, None), "near-groups")


def _shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # rows may be repeated
    for batch in batches:
        for part, texts in _sliced(batch):
            sets, of = shingle_sets(texts), part.column("of").to_pylist()
            right = [i for i, c in enumerate(of) if c not in seen and i == of.index(c)]
            seen.update(of)
            chosen = part.take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [chosen.column("of"), chosen.column("group"), chosen.column("blocks"),
                 pa.array([signatures([sets[i]])[0].tobytes() for i in right], pa.binary()),
                 pa.array([sets[i].tobytes() for i in right], pa.binary())],
                ["class", "group", "blocks", "signature", "shingles"],
            )


def _confirmed(docs: DataFrame, classes: DataFrame, groups: DataFrame, most: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of a group whose full sets are similar enough: a spanning forest.

    The documents of a group are dealt to blocks. First one block, the hubs, meets all others,
    which is all there is to do in most groups and links most of a large one. Blocks are then
    dealt anew by what is linked, and all pairs of blocks meet that are not linked throughout.
    """
    members = groups.join(classes, groups["node"] == classes["class"]).select("class", F.col("root").alias("group"), "mark", "n_shingles")
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    sizes = keep(sizes.select("group", "n", blocks.alias("blocks")), "near-sizes")
    members = keep(join_counted(members, sizes, ["group"], "n", ["class"]).drop("n"), "near-members")

    reps = members.select(F.col("class").alias("of"), "group", "blocks", "mark")
    texts = docs.join(small(reps), "mark").select("text", "of", "group", "blocks")
    rows = texts.mapInArrow(_shingles, "class long, group long, blocks int, signature binary, shingles binary")
    rows = keep(rows, "near-shingles")

    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    hubs = rows.withColumn("own", own).withColumn("j", F.explode(F.when(F.col("own") == 0, everywhere).otherwise(F.array("own"))))
    side = F.when(F.col("own") != 0, 1).when(F.col("j") == 0, 2).otherwise(0)
    first = _in_groups(hubs.withColumn("side", side), ["group", "j"], most, percent, hubs=True)
    first = keep(first, "near-hub-links")
    rest = rows.filter("blocks > 1")
    if rest.isEmpty():
        return first

    # what is surely linked: the root in the own block's task, which is a hub where there is one, and its root
    roots = keep(first.groupBy("a").agg(F.min("b").alias("root")), "near-roots")
    one, two = (roots.select(F.col("a").alias(f"a{i}"), F.col("root").alias(f"root{i}")) for i in (1, 2))
    rest = rest.join(one, F.col("class") == F.col("a1"), "left").join(two, F.col("root1") == F.col("a2"), "left")
    rest = rest.withColumn("root", F.coalesce("root2", "root1", "class"))
    rest = keep(rest.select("class", "group", "signature", "shingles", "root"), "near-rest")
    sizes = rest.groupBy("group", "root").agg(F.count("*").alias("n"))
    # large linked parts have blocks of their own; all else of a group is dealt together
    part = F.when(F.col("n") >= BLOCK, F.col("root"))
    parts = keep(sizes.withColumn("part", part), "near-parts")
    counts = parts.groupBy("group", "part").agg(F.sum("n").alias("rows"))
    counts = keep(counts.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")), "near-part-blocks")
    block = counts.select("group", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    left = block.select("group", F.col("part").alias("part_i"), F.col("own").alias("own_i"))
    right = block.select("group", F.col("part").alias("part_j"), F.col("own").alias("own_j"))
    at = [F.struct(F.coalesce(f"part_{x}", F.lit(-(2**63))), f"own_{x}") for x in "ij"]
    pairs = left.join(right, "group").filter((at[0] <= at[1]) & ~F.coalesce(F.col("part_i") == F.col("part_j"), F.lit(False)))
    pairs = pairs.select("*", F.xxhash64("part_i", "own_i", "part_j", "own_j").alias("pair"), (at[0] == at[1]).alias("self"))
    halves = pairs.select("group", "pair", F.col("part_i").alias("part"), F.col("own_i").alias("own"), F.when(F.col("self"), 2).otherwise(0).alias("side"))
    halves = halves.unionAll(
        pairs.filter("not self").select("group", "pair", F.col("part_j").alias("part"), F.col("own_j").alias("own"), F.lit(1).alias("side"))
    )
    rest = rest.join(parts.select("group", "root", "part"), ["group", "root"])
    rest = rest.join(counts.select(F.col("group").alias("g"), F.col("part").alias("p"), "blocks"), (F.col("group") == F.col("g")) & F.col("part").eqNullSafe(F.col("p")))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("class", F.lit("again")), F.col("blocks")).cast("int")).drop("g", "p", "blocks")
    halves = halves.select(F.col("group").alias("g"), F.col("part").alias("p"), F.col("own").alias("o"), "pair", "side")
    meet = rest.join(halves, (F.col("group") == F.col("g")) & (F.col("own") == F.col("o")) & F.col("part").eqNullSafe(F.col("p")))
    second = _in_groups(meet.select("group", "pair", "side", "class", "root", "signature", "shingles"), ["group", "pair"], most, percent)
    return first.unionAll(keep(second, "near-rest-links"))


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, most: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A set holds the distinct runs of five words, A-Z in lower case; a shorter text is one run,
    and a text without words, or null, has an empty set and stays alone. Documents whose sets
    are similar (intersection by union, in whole per cent, at least) are linked;
    component_id is the smallest doc_id that links lead to, and the row with that id is kept.
    Rows with the same set are one class and linked whatever their ids; null ids do not
    count for component_id, and a component of nothing else has null and keeps its rows.

    Pairs up to ``most`` signature positions apart are looked at, and all of them meet in the
    index. By default that is the mean of pairs at the threshold and four and a half standard
    deviations; what is left out are pairs whose signatures are further apart than that: of
    pairs of exactly the threshold 2 in 100,000 at 0.85 and 3 at 0.8, 0.7 at 0.7 (binomial).
    Lower thresholds need more and shorter keys.
    """
    percent = round(100 * similarity)
    if most is None:
        spread = (POSITIONS * similarity * (1 - similarity)) ** 0.5
        most = max(GUARANTEED, int(POSITIONS * (1 - similarity) + 4.5 * spread))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("doc_id", "text"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = short_batches(docs).mapInArrow(_sign, f"doc_id {kind}, mark long, n_shingles long, class long, signature binary")
    rows = keep(rows, "near-rows")
    classes = rows.filter("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.min("mark").alias("mark"), F.count("*").alias("n"),
        F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"),
    )
    classes = keep(classes, "near-classes")
    links = _confirmed(docs, classes, candidate_groups(classes, most), most, percent)
    found = components(links, "near-found")
    named = classes.join(found, F.col("class") == F.col("node"), "left").select("class", "rep", "n", F.coalesce("root", "class").alias("root"))
    named = keep(named, "near-named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    # roots are joined to as many classes as a component has, which Spark may split
    named = keep(named.join(least, "root").select("class", "n", "component_id"), "near-labels")
    full = join_counted(rows.filter("class is not null").drop("signature", "mark"), named, ["class"], "n", ["doc_id"])
    empty = rows.filter("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = full.select("doc_id", "n_shingles", "component_id").unionAll(empty)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query(
    "op7_near_dedup",
    """
    with recursive w as (
      select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words
      from documents),
    s as (
      select distinct doc_id, unnest(case when len(words) < 5 then [array_to_string(words, ' ')]
        else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) end) as shingle
      from w where len(words) > 0),
    n as (select doc_id, count(*) as n from s group by all),
    pairs as (
      select a.doc_id as a, b.doc_id as b, count(*) as shared
      from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
    links as (
      select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b
      where 100 * shared >= 85 * (x.n + y.n - shared)),
    reach as (
      select doc_id as a, doc_id as b from documents
      union
      select reach.a, links.b from reach join links on reach.b = links.a),
    least as (select a as doc_id, min(b) as component_id from reach group by all)
    select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
    from least left join n using (doc_id)
    """,
)
def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(read(spark, folder, "documents"), similarity=0.85)
