"""Stages of the pipeline over rows with null and repeated ids, against brute force."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline as P
from recordloom.llm.toxicity import OrdinalModel
from tests.llm.tables import cases, docs, words

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def squeezed(text):
    return SPACES.sub("", text or "")


def odd_ids():
    """Copies without an id, one id of different texts, and rows that are the same throughout."""
    text = words(50, 60)
    near = text.rsplit(" ", 1)[0] + " end"
    return [(None, text), (None, text), (1, near), (1, words(51, 60)), (2, words(51, 60)), (3, words(52, 60)), (3, words(52, 60)), (None, near)]


def test_toxic_rows_go_by_their_own_text(spark, monkeypatch):
    model = OrdinalModel({"=foul": 0}, np.array([9.0]), np.array([1.0, 2.0]))
    monkeypatch.setattr(P, "fit_toxicity", lambda *a: model)
    monkeypatch.setattr(P, "read", lambda *a: None)
    rows = [(1, "foul", None, None, None), (1, "fine", None, None, None), (None, "so foul", None, None, None), (None, None, None, None, None)]
    left = P.toxicity(spark, docs(spark, rows), "")
    assert sorted(map(str, rows_of(left))) == sorted(map(str, [(1, "fine"), (None, None)]))
    assert left.columns == docs(spark, rows).columns
    assert P.toxicity(spark, docs(spark, []), "").count() == 0


@pytest.mark.parametrize("rows", [cases(), [(i, t, "en", "a", 1) for i, t in odd_ids()], []])
def test_exact_dedup_keeps_one_row_of_each_text(spark, rows):
    got = P.exact_dedup(spark, docs(spark, rows), "")
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(squeezed(text), []).append((doc_id, text))
    want = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert sorted(map(str, rows_of(got))) == sorted(map(str, want))
    assert got.columns == docs(spark, rows).columns


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


@pytest.mark.parametrize("rows", [cases(), [(i, t, "en", "a", 1) for i, t in odd_ids()], []])
def test_near_dedup_keeps_one_row_of_each_group(spark, rows):
    got = P.near_dedup(spark, docs(spark, rows), "")
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    groups = {}
    for r, at in zip(rows, label):
        groups.setdefault(at, []).append(r[0])
    want = [min(g, key=lambda i: (i is None, i or 0)) for g in groups.values()]
    left = rows_of(got)
    assert sorted(map(str, (i for i, _ in left))) == sorted(map(str, want))
    assert {frozenset(shingles(t)) for _, t in left} <= {frozenset(s) for s in sets}
    assert got.columns == docs(spark, rows).columns


def test_columns_of_any_name_stay(spark):
    names = ["_row", "_one", "_two", "row", "ONE", "two", "kept", "n", "doc"]
    df = docs(spark, [(1, words(1, 30), "en", "a", 1), (2, words(1, 30), "en", "a", 1), (3, words(2, 30), None, "b", 1)]).drop(*names)
    df = df.withColumns({c: F.lit(c) for c in names})
    for stage in (P.exact_dedup, P.near_dedup):
        left = stage(spark, df, "")
        assert left.columns == df.columns and left.count() == 2
        assert all(r[c] == c for r in left.collect() for c in names)
    assert P.mixing(spark, df.drop("n_chars"), "").columns == df.drop("n_chars").columns


@pytest.mark.parametrize("rows", [cases(), [(i, t, "en", "a", 1) for i, t in odd_ids()], []])
def test_mixing_shows_words_of_the_documents(spark, rows):
    """Words come from their rows in order; sources take about their targets; no row is shown over three times its size."""
    got = P.mixing(spark, docs(spark, rows), "")
    texts, size, shown, source = {}, {}, {}, {}
    for i, text, lang, of, _ in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        texts.setdefault(i, []).append(found)
        size[i], source[of] = size.get(i, 0) + len(found), source.get(of, 0) + len(found)
    taken = dict.fromkeys(source, 0)
    for r in got.collect():
        found = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        shown[r["doc_id"]] = shown.get(r["doc_id"], 0) + len(found)
        taken[r["source"]] += len(found)
        assert r["n_chars"] == len(r["text"])
        assert any(all(w in it for w in found) for it in map(iter, texts[r["doc_id"]]))
    assert all(n <= 3 * size[i] for i, n in shown.items())
    weight = dict(zip(sorted(source, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9))
    total, open_, target = sum(source.values()), {s for s in source if source[s]}, {}
    while open_:
        left, all_ = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / all_ > 3 * source[s]}
        target |= {s: 3 * source[s] for s in over} if over else {s: left * weight[s] / all_ for s in open_}
        open_ = open_ - over if over else set()
    assert all(abs(taken[s] - target[s]) <= 64 + 0.01 * target[s] for s in target)


def test_tokens_are_those_of_the_library(spark):
    ranks = load_tiktoken_bpe(str(public_tokenizers.path(P.RANKS)))
    known = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text, *_ in cases():
        ids = known.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    got = P.tokenize(spark, docs(spark), "").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_the_chain_is_its_stages(spark, tmp_path):
    """Every stage gets all that the one before it kept, as written, and its result is what the next one reads."""
    folder = str(tmp_path)
    rows = [(k, f"{words(k % 25, 40)} {'!' * (k % 2)}", "en", "ab"[k % 2], 1) for k in range(80)] + cases()
    docs(spark, rows, clash=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        df = stage(spark, df, folder)
        if k < len(P.STAGES) - 1:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            df.write.parquet(f"{folder}/{name}")
            df = spark.read.parquet(f"{folder}/{name}")
    assert sorted(map(str, df.collect())) == sorted(map(str, P.run(spark, folder).collect()))
