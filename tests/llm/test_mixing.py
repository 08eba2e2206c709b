"""Source mixing: targets, permutations, whole blocks, texts."""

import re

import pytest
from pyspark.sql import functions as F

from recordloom.llm import mixing
from recordloom.llm.mixing import Mix, _dealt_slots, _drawn_slots, permuted, source_targets
from tests.llm.tables import cases, docs, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Excess reshared by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
        open_ -= set(over)
        left = sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize(
    "sizes", [{"a": 100}, {"a": 1, "b": 1000, "c": 5, "d": 0, None: 70}, {"ß": 10, "z": 10, "Z": 10}, {"a": 0, "b": 0}, {f"s{i}": i * i for i in range(40)}]
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(4)).alias("p"))
    assert sorted(r["p"] for r in df.collect()) == list(range(n))


def rows(n=600):
    return [(i, words(i, 5 + i % 90), "en", "hot" if i % 3 else f"s{i % 4}", i) for i in range(n)]


def test_mix_meets_its_targets(spark):
    mix = Mix(docs(spark, rows()), block=16, shard_slots=100)
    taken = [r.asDict() for r in mix.taken().collect()]
    sizes, got = {}, {}
    for i, text, _, source, _ in rows():
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text))
    source_of = {r[0]: r[3] for r in rows()}
    for r in taken:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[source_of[r["doc_id"]]]
        got[source_of[r["doc_id"]]] = got.get(source_of[r["doc_id"]], 0) + r["taken"]
    want = brute_targets(sizes)
    assert all(abs(got.get(s, 0) - want[s]) <= 32 for s in want)
    # every slot once, shards full but the last, blocks of the fixed length but a source's last
    slots = mix.slots.select((F.col("shard") * 100 + F.col("slot")).alias("g")).collect()
    assert sorted(r["g"] for r in slots) == list(range(len(slots)))
    lengths = mix.rows().groupBy("shard", "slot").agg(F.sum("words").alias("w")).groupBy("w").count().collect()
    assert max(lengths, key=lambda r: r["count"])["w"] == 16 and all(r["w"] <= 16 for r in lengths)
    # counts of a source differ between shards, as drawn ones do
    counts = mix.shard_counts().groupBy("source_no").agg(F.countDistinct("slots").alias("k")).collect()
    assert max(r["k"] for r in counts) > 2
    again = Mix(docs(spark, rows()[::-1]).repartition(7), block=16, shard_slots=100).taken()
    assert sorted(map(str, again.collect())) == sorted(map(str, mix.taken().collect()))


def test_texts_hold_the_words_taken(spark):
    df = docs(spark, rows(200))
    mix = Mix(df, block=8)
    shown = mix.texts(df)
    assert shown.columns == df.columns
    got = {r["doc_id"]: r["n"] for r in shown.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    assert got == {r["doc_id"]: r["taken"] for r in mix.taken().collect() if r["taken"]}
    whole = {r[0]: r[1] for r in rows(200)}
    for r in shown.collect():
        it = iter(WORD.findall(whole[r["doc_id"]]))
        assert all(w in it for w in WORD.findall(r["text"]))  # in the order of the document


@pytest.mark.parametrize("slots", [_drawn_slots, _dealt_slots])
def test_shards_draw_multinomial_counts(spark, slots):
    n = {1: 6_000, 2: 3_000, 4: 1_000}
    of = spark.createDataFrame([(s, 100 * s, k) for s, k in n.items()], "source_no int, blocks long, n long")
    got = slots(of, 100, 0).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(i // 100, i % 100) for i in range(10_000)]
    for s, k in n.items():
        own = [r for r in got if r["source_no"] == s]
        assert sorted(r["k"] for r in own) == list(range(k)) and {r["blocks"] for r in own} == {100 * s}
        counts = [sum(r["shard"] == i for r in own) for i in range(90)]  # what is beyond a target lies in the last shards
        p, mean = k / 10_000, sum(counts) / 90
        spread = sum((c - mean) ** 2 for c in counts) / 89
        assert abs(mean - 100 * p) < 2 and 0.6 < spread / (100 * p * (1 - p)) < 1.6
    assert sorted(map(str, got)) == sorted(map(str, slots(of.repartition(3), 100, 0).collect()))


def test_many_sources_are_dealt_by_one_permutation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DRAWN_SOURCES", 2)
    test_mix_meets_its_targets(spark)


def test_repeated_rows_and_null_ids_show_what_each_drew(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_AT_ONCE", 4)
    monkeypatch.setattr(mixing, "CHUNK_DOCS", 20)
    same = words(5, 40)
    table = [(7, same, "en", "a", 1)] * 9 + [(None, words(k, 30), "en", "a", 1) for k in range(60)] + [(k, words(k, 50), "en", "b", 1) for k in range(30)]
    df = docs(spark, table).withColumns({c: F.lit("clash") for c in ["_id", "_source", "_size", "_epochs", "one", "two", "copy", "doc", "spans", "epoch"]})
    mix = Mix(df, block=8)
    assert mix.documents.count() == 99 and mix.documents.filter("doc_id = 7").select("copy").distinct().count() == 9
    assert mix.documents.groupBy("source_no", "start").count().filter("count > 1").isEmpty()
    shown = mix.texts(df)
    assert shown.columns == df.columns
    count = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")
    got = {(r["doc_id"], r["source"]): r["n"] for r in shown.groupBy("doc_id", "source").agg(count).collect()}
    taken = mix.taken().groupBy("doc_id", "source_size").agg(F.sum("taken").alias("n")).collect()
    assert sum(r["n"] for r in taken) == sum(got.values())
    assert got[7, "a"] == sum(r["n"] for r in taken if r["doc_id"] == 7 and r["source_size"] == 9 * 40 + 60 * 30)
    again = Mix(df.repartition(5), block=8).texts(df)
    assert sorted(map(str, again.collect())) == sorted(map(str, shown.collect()))


def test_mix_of_the_cases(spark):
    df = docs(spark)
    taken = Mix(df).taken().collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in taken) == sorted((str(c[0]), len(WORD.findall(c[1] or ""))) for c in cases())
    assert all(r["taken"] <= 3 * r["size"] for r in taken)
    assert Mix(df).texts(df).columns == df.columns
    empty = docs(spark, [])
    assert Mix(empty).taken().count() == 0 and Mix(empty).texts(empty).count() == 0
