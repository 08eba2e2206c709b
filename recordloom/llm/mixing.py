"""Mix sources to target weights: fixed-length blocks, drawn counts per shard, permuted indexes.

Every source is one long stream of words, cut into blocks of the same length. Its target says
how many slots of the output its blocks fill. The output is shards of so many slots, and every slot
draws its source by the shares of the targets: the counts of a shard are a multinomial draw. A
source's slots are numbered through the shards; those beyond its target, which lie in the last
shards, go to the sources that drew too few, so that all meet their targets. The numbers of a
source count through a pseudorandom permutation of its blocks, again and again if the target
is above the source's size, and slots and blocks meet by source and index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.registry import query
from recordloom.llm.shared import keep, read, row_key, small

WORD = "[^\\x20\\x09-\\x0D]+"
#: A word with the white space before it.
SPACED_WORD = "([\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+)"
BLOCK = 64
SHARD_SLOTS = 4_096
#: A source's documents are laid end to end in chunks of about so many.
CHUNK_DOCS = 5_000
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
ROUNDS = 20
ROWS_AT_ONCE = 65_536
#: Up to so many sources their shares are an expression; of more, slots are dealt by one permutation.
DRAWN_SOURCES = 1_000


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0..n-1.

    Swap-or-not: each round pairs x with its mirror image about a keyed centre and swaps them
    by a bit that both share, so every round, and the whole, is a permutation for any n.
    """

    def swap(x, step):
        centre = F.pmod(F.xxhash64(F.lit("centre"), step, *key), n)
        mirror = F.pmod(centre - x + n, n)
        bit = F.xxhash64(F.lit("swap"), step, F.greatest(x, mirror), *key).bitwiseAND(F.lit(1))
        return F.when(bit == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, swap)


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, share: float = 1.0
) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): adds source_no and target.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of the sum of
    all sizes. No target is above ``max_repeat`` times its size; the excess goes to the others
    by weight. That is one level for all: in the order of limit by weight, sources up to
    some place are at their limits and the rest share what is left. One row per source.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("source_no") - 1, F.lit(len(weights))))
    limit = F.col("source_size") * F.lit(float(max_repeat))
    limits = (
        sizes.withColumn("source_no", number)
        .withColumns({"weight": weight, "limit": limit})
        .withColumn("level", F.col("limit") / F.col("weight"))
    )
    up_to = Window.orderBy("level", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("level", "source_no").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("limit").over(up_to), F.lit(0.0))
    levels = limits.withColumn("even", left / F.sum("weight").over(onward))
    open_level = F.when(F.col("even") < F.col("level"), F.struct("level", "source_no", "even"))
    first = F.min(open_level).over(everything)
    target = F.coalesce(F.least("limit", F.col("weight") * first["even"]), "limit")
    return levels.select("source", "source_no", "source_size", target.alias("target"))


#: What tells a row of ``documents`` from all others.
ROW = ["one", "two", "copy"]


def _counted(df: DataFrame, n: str, name: str, key: list[str]) -> DataFrame:
    """``df`` with each row ``n`` times and numbered from 0, without ``n``: in two steps, as one row may stand for most."""
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(ROWS_AT_ONCE).cast("long")))
    steps = df.withColumn("from", step).repartition(*key, "from")
    upto = F.least(F.col("from") + ROWS_AT_ONCE, n) - 1
    return steps.withColumn(name, F.explode(F.sequence("from", upto))).drop("from", n)


def _dealt_slots(of: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """shard, slot, source_no, k, blocks: the slots of ``of`` (source_no, blocks, n) in the order of one permutation.

    What a shard gets of each source is then a multinomial draw, conditioned on the totals.
    """
    all_before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    of = of.withColumn("begin", F.coalesce(F.sum("n").over(all_before), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    slots = _counted(of.withColumn("times", F.col("n")), "times", "k", ["source_no"])
    place = permuted(F.col("begin") + F.col("k"), F.col("all"), F.lit(seed))
    slots = slots.select(place.alias("place"), "source_no", "k", "blocks")
    return slots.select(F.expr(f"place div {shard_slots}").alias("shard"), F.expr(f"place % {shard_slots}").alias("slot"), "source_no", "k", "blocks")


def _drawn_slots(of: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """shard, slot, source_no, k, blocks: every slot draws its source; those beyond a target go where some are lacking.

    ``of`` (source_no, blocks, n) has at most DRAWN_SOURCES rows, which are read by the driver and
    become expressions. ``k`` numbers the slots of a source from 0 to n - 1.
    """
    spark = of.sparkSession
    sources = sorted((r["source_no"], r["blocks"], r["n"]) for r in of.collect())
    total = sum(n for _, _, n in sources)
    at = spark.range(total).select(F.expr(f"id div {shard_slots}").alias("shard"), F.expr(f"id % {shard_slots}").alias("slot"))

    def pick(values: list, place: Column) -> Column:
        return F.get(F.array(*map(F.lit, values or [0])), place)

    def steps(counts: list[int]) -> list[int]:
        return [sum(counts[: i + 1]) for i in range(len(counts))]

    def place_of(x: Column, bounds: list[int]) -> Column:
        """How many of the rising ``bounds`` are at or below x."""
        return F.size(F.filter(F.array(*map(F.lit, bounds or [0])), lambda b: b <= x))

    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("source"), "shard", "slot"), F.lit(max(total, 1)))
    drawn = at.withColumn("no", place_of(draw, steps([n for _, _, n in sources])))
    # numbers inside a shard, of which none has more slots than the others
    inside = Window.partitionBy("shard", "no").orderBy("slot")
    drawn = keep(drawn.withColumn("k", F.row_number().over(inside) - 1), "mix-draws")
    counts = drawn.groupBy("no", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = keep(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "mix-draw-counts")
    got = {r["no"]: r["n"] for r in counts.groupBy("no").agg(F.sum("n").alias("n")).collect()}  # a row per source
    lacking = [max(0, n - got.get(i, 0)) for i, (_, _, n) in enumerate(sources)]

    named = drawn.join(counts.drop("n"), ["no", "shard"]).withColumn("k", F.col("k") + F.col("before")).drop("before")
    wanted = pick([n for _, _, n in sources], F.col("no"))
    own, beyond = named.filter(F.col("k") < wanted), named.filter(F.col("k") >= wanted)
    # what is beyond is numbered through all shards
    beyond = beyond.withColumn("m", F.row_number().over(Window.partitionBy("shard").orderBy("slot")) - 1)
    rest = beyond.groupBy("shard").agg(F.count("*").alias("n"))
    rest = rest.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    beyond = beyond.join(rest, "shard").withColumn("m", F.col("m") + F.col("before"))
    beyond = beyond.withColumn("no", place_of(F.col("m"), steps(lacking)))
    begins = [got.get(i, 0) - sum(lacking[:i]) for i in range(len(sources))]
    beyond = beyond.withColumn("k", F.col("m") + pick(begins, F.col("no"))).select(*named.columns)
    every = own.unionAll(beyond)
    return every.select("shard", "slot", pick([s for s, _, _ in sources], F.col("no")).alias("source_no"), "k", pick([b for _, b, _ in sources], F.col("no")).alias("blocks"))


class Mix:
    """A mix of ``docs``: ``documents``, ``sources``, ``slots`` and ``pieces`` are DataFrames.

    A size is a number of words; a null text has none, and a null source is one of its own. An
    empty table gives an empty mix. Reruns agree: nothing depends on how rows are dealt to tasks.
    Ids may be null or repeat: rows are told apart by two hashes of all their columns, and rows that are
    the same throughout, which are as good as one another, by a number.

    ``documents``  one, two, copy, doc_id, source_no, size, start (in its source's stream), source_size, target
    ``slots``      shard, slot, source_no, epoch, block: ``slot`` of ``shard`` shows ``block`` for the
                   ``epoch``-th time
    ``pieces``     one, two, copy, source_no, block, first, words: the words of a block that are
                   words ``first`` to ``first + words`` of a document

    Every source's slots are its target in blocks of its mean length, so at most ``max_repeat``
    for each block, and no document is taken more often.
    """

    def __init__(
        self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0,
        block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0,
    ):
        words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
        key = row_key(docs, doc_id)
        rows = docs.select(key["one"].alias("one"), key["two"].alias("two"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"))
        rows = keep(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "mix-sizes")
        sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
        self.sources = keep(source_targets(sizes, weights, max_repeat, share), "mix-sources")
        chunks = max(1, -(-(rows.agg(F.sum("copies")).first()[0] or 0) // CHUNK_DOCS))

        numbered = small(self.sources.withColumnRenamed("source", "of"))
        rows = rows.join(numbered, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
        rows = _counted(rows, "copies", "copy", ["one", "two"])
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("one", "two", "copy", F.lit(seed)), F.lit(chunks)))
        part = ["source_no", "chunk"]
        before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        begins = rows.groupBy(*part).agg(F.sum("size").alias("words"))
        begins = begins.select(*part, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("begin"))
        inside = Window.partitionBy(*part).orderBy(*ROW).rowsBetween(Window.unboundedPreceding, 0)
        placed = rows.withColumn("start", F.sum("size").over(inside) - F.col("size")).join(begins, part)
        placed = placed.withColumn("start", F.col("start") + F.col("begin")).drop("begin", "chunk")
        self.documents = keep(placed, "mix-documents")

        size = F.lit(block)
        first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
        filled = self.documents.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        begin = F.greatest("start", F.col("block") * size)
        end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
        self.pieces = filled.select(*ROW, "source_no", "block", (begin - F.col("start")).alias("first"), (end - begin).alias("words"))
        blocks = F.ceil(F.col("source_size") / size)
        wanted = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
        of = self.sources.filter("source_size > 0").withColumn("blocks", blocks).withColumn("n", wanted)
        of = keep(of.filter("n > 0").select("source_no", "blocks", "n"), "mix-slots-of")
        drawn = _drawn_slots(of, shard_slots, seed) if of.count() <= DRAWN_SOURCES else _dealt_slots(of, shard_slots, seed)
        shown = permuted(F.pmod("k", "blocks"), F.col("blocks"), F.lit(seed), F.col("source_no"))
        self.slots = drawn.select("shard", "slot", "source_no", F.expr("k div blocks").alias("epoch"), shown.alias("block"))

    def rows(self) -> DataFrame:
        """The mix: each slot's pieces, by shard and slot; blocks meet slots by source and index.

        Both grow with the corpus, which Spark cannot tell of rows made by ``explode``: without
        the hint it would take the slots for as small as the sources and broadcast them.
        """
        return self.slots.hint("merge").join(self.pieces, ["source_no", "block"])

    def shard_counts(self) -> DataFrame:
        """How many slots each shard drew from each source."""
        return self.slots.groupBy("shard", "source_no").agg(F.count("*").alias("slots"))

    def taken(self) -> DataFrame:
        """Per document, ``taken``: the words the mix takes from it, repeats counted."""
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        taken = self.pieces.join(times.hint("merge"), ["source_no", "block"])
        taken = taken.groupBy(*ROW).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        return self.documents.join(taken.hint("merge"), ROW, "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )

    def texts(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` as the mix shows them: a row per document and epoch with the words taken, in order.

        The other columns stay. Words keep the white space before them. Of rows that are the same
        throughout each shows what was drawn for it.
        """
        spans = self.rows().groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("epoch", "first", "words"))).alias("spans"))
        key, hashes = row_key(docs, doc_id), ROW[:2]
        rows = docs.select(F.struct(*docs.columns).alias("doc"), key["one"].alias("one"), key["two"].alias("two"))
        again = keep(self.documents.filter("copy = 1").select(*hashes), "mix-again")  # rows that are there more than once
        if again.isEmpty():
            once = rows
        else:
            once = rows.join(small(again), hashes, "left_anti")
            once = once.unionAll(rows.join(small(again), hashes, "left_semi").dropDuplicates(hashes))
        shown = once.join(spans.hint("merge"), hashes).withColumn("epoch", F.explode(F.array_distinct("spans.epoch")))
        # a mark per word, so that the text is split once and not for every span
        spans = F.filter("spans", lambda span: span["epoch"] == F.col("epoch"))

        def mark(span, i):
            last = F.get(spans, i - 1)
            gap = span["first"] - F.when(i > 0, last["first"] + last["words"]).otherwise(0)
            return F.concat(F.array_repeat(F.lit(False), gap.cast("int")), F.array_repeat(F.lit(True), span["words"].cast("int")))

        marks = F.transform(spans, mark)
        words = F.regexp_extract_all(F.col("doc").getField(text), F.lit(SPACED_WORD), F.lit(1))
        marked = F.arrays_zip(words.alias("word"), F.flatten(marks).alias("taken"))
        part = F.array_join(F.filter(marked, lambda w: w["taken"])["word"], "")
        return shown.select(*[(part if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])


@query("op4_source_mix")
def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return Mix(read(spark, folder, "documents")).taken()
