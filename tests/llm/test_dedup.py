"""Exact, near and line dedup against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from recordloom.llm import near_dedup
from recordloom.llm.components import components
from recordloom.llm.exact_dedup import exact_groups, without_spaces
from recordloom.llm.near_dedup import GUARANTEED, POSITIONS, near_groups, shingle_sets, signatures
from recordloom.llm.unit_dedup import repeated_units, text_units, without_spans
from tests.llm.tables import cases, docs, words

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_groups(spark):
    digest = F.sha2(without_spaces(F.col("text")), 256)
    got = [tuple(r) for r in exact_groups(docs(spark), carry={"text_sha256": digest}).collect()]
    groups = {}
    for doc_id, text, *_ in cases():
        groups.setdefault(SPACES.sub("", text or ""), []).append((doc_id, len(text or "")))
    want = []
    for text, rows in groups.items():
        keep = min(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[0]
        want += [(i, keep, len(rows), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i, _ in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert exact_groups(docs(spark, [])).count() == 0


def test_exact_groups_beyond_broadcasts_and_with_a_hot_group(spark, monkeypatch):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i % 50} {'x' * (i % 7)}", "en", "a", 1) for i in range(3_000)]
    df = spark.createDataFrame(rows, docs(spark, [], clash=False).schema)
    want = sorted(map(str, exact_groups(df).collect()))
    monkeypatch.setattr("recordloom.llm.exact_dedup.small", lambda df: df)
    assert sorted(map(str, exact_groups(df).collect())) == want
    assert {r["group_size"] for r in exact_groups(df).filter("doc_id % 3 = 0").collect()} == {1000}


def brute_near(rows, percent):
    sets = []
    for _, text in rows:
        found = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(map(str, out))


def edited(text, seed, n):
    draw, found = random.Random(seed), text.split(" ")
    for _ in range(n):
        found[draw.randrange(len(found))] = f"new{draw.random()}"
    return " ".join(found)


def families():
    """Copies of a few texts with more and more edits, dealt at random."""
    rows = []
    for f in range(4):
        base = words(100 + f, 150)
        rows += [edited(base, 1000 * f + k, k % 6) for k in range(40)]
    random.Random(5).shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_near_groups_of_the_cases(spark):
    got = sorted(map(str, (tuple(r) for r in near_groups(docs(spark), similarity=0.85).collect())))
    assert got == brute_near([(r[0], r[1]) for r in cases()], 85)
    assert near_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block", [256, 4])
def test_near_groups_of_families_in_blocks(spark, monkeypatch, block):
    """Small blocks send a family through the hubs and the pairs of blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = [(i, t, "en", "a", 1) for i, t in families()]
    df = docs(spark, rows)
    if block == 4:
        monkeypatch.setattr(near_dedup.dealt_blocks, "__defaults__", (block,))
    got = sorted(map(str, (tuple(r) for r in near_groups(df, similarity=0.85).collect())))
    assert got == brute_near(families(), 85)


def test_every_pair_under_the_guaranteed_distance_shares_a_key(spark):
    draw, rows = random.Random(3), []
    for i in range(200):
        a = bytes(draw.randrange(256) for _ in range(POSITIONS))
        b = bytearray(a)
        for p in draw.sample(range(POSITIONS), GUARANTEED):
            b[p] ^= 1 + draw.randrange(255)
        rows.append((i, bytearray(a), b))
    df = spark.createDataFrame(rows, "i int, a binary, b binary")
    shared = F.arrays_overlap(near_dedup.index_keys(F.col("a")), near_dedup.index_keys(F.col("b")))
    assert df.filter(shared).count() == 200


@pytest.mark.parametrize("most", [18, 22, 26, 35, 49, POSITIONS])
def test_every_pair_that_is_looked_at_shares_a_key(spark, most):
    draw, rows = random.Random(most), []
    for i in range(300):
        a = bytes(draw.randrange(256) for _ in range(POSITIONS))
        b = bytearray(a)
        # as even over the chunks as can be, and at random
        even = [p for k in range(7) for p in range(k, POSITIONS, 7)][:most]
        for p in even if i % 2 else draw.sample(range(POSITIONS), most):
            b[p] ^= 1 + draw.randrange(255)
        rows.append((i, bytearray(a), b))
    df = spark.createDataFrame(rows, "i int, a binary, b binary")
    keys = [near_dedup.index_keys(F.col(c), most) for c in "ab"]
    assert df.filter(F.arrays_overlap(*keys)).count() == 300


def test_signatures_estimate_similarity():
    a = words(1, 400)
    x, y = signatures(shingle_sets([a.encode(), edited(a, 1, 8).encode()]))
    one, two = (set(s.tolist()) for s in shingle_sets([a.encode(), edited(a, 1, 8).encode()]))
    assert abs((x == y).mean() - len(one & two) / len(one | two)) < 0.2


def test_components(spark):
    draw = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, j) for j in range(501, 900)]
    links += [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    assert got == {i: root(i) for i in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark):
    rows = [r for r in cases()]
    got = sorted(str(tuple(r)) for r in repeated_units(docs(spark)).collect())
    seen = {}
    for doc_id, text, *_ in rows:
        at = 0
        for line in (text or "").split("\n"):
            found = line.encode().lower().split()
            if len(found) >= 20:
                seen.setdefault(b" ".join(found), []).append((doc_id is None, doc_id, at, at + len(line), len(found)))
            at += len(line) + 1
    want = []
    for places in seen.values():
        first, *rest = sorted(places, key=lambda p: (p[0], p[1] or 0, p[2]))
        want += [(p[1], p[2], p[3], p[4], first[1], first[2], first[3], len(places)) for p in rest]
    assert got == sorted(map(str, want)) and want
    assert repeated_units(docs(spark, [])).count() == 0


def test_spans_cut_the_units_out(spark):
    df = docs(spark, [(1, "a b\nc d e f\ng", None, None, None), (2, "x\n C  d e F\ny", None, None, None)])
    spans = repeated_units(df, min_words=3)
    assert [(r["doc_id"], r["start"], r["end"]) for r in spans.collect()] == [(2, 2, 11)]
    assert {r["doc_id"]: r["text"] for r in without_spans(df, spans).collect()} == {1: "a b\nc d e f\ng", 2: "x\ny"}


def test_paragraphs(spark):
    df = docs(spark, [(1, "a b\nc\n\n d e\n \nf", None, None, None)])
    spans = [(r["start"], r["end"]) for r in text_units(df, unit="paragraph").orderBy("start").collect()]
    assert ["a b\nc\n\n d e\n \nf"[a:b] for a, b in spans] == ["a b\nc", "d e", "f"]
