"""Encoding, decoding and token counts against the tokenizer library called row by row."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.llm.byte_bpe import RANKS, decode, encode, encode_text, encoding, rank_bytes, round_trip
from recordloom.llm.token_counts import attribute, field_sections, sentence_sections, section_tokens
from tests.llm.tables import cases, docs

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def enc():
    return encoding(rank_bytes(PATH), public_tokenizers.PATTERN)


def test_round_trip_equals_the_library(spark, enc):
    got = sorted(map(tuple, round_trip(docs(spark), PATH).collect()), key=str)
    want = []
    for doc_id, text, *_ in cases():
        ids = np.asarray(enc.encode_ordinary(text or ""), "<u4")
        raw = (text or "").encode()
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want, key=str)
    assert round_trip(docs(spark, []), PATH).count() == 0


def test_columns_pass_through_and_bytes_come_back(spark):
    df = encode(docs(spark), PATH)
    assert "source" in df.columns and dict(df.dtypes)["ids"] == "binary"
    back = decode(df, PATH).select("doc_id", F.decode("decoded", "UTF-8").alias("text"))
    assert sorted(map(str, back.collect())) == sorted(
        map(str, docs(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    )


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 1é'\n\t!st.’　\x85ǅ٣\U0001f600", max_size=80), st.integers(1, 9))
def test_chunks_do_not_change_ids(text, size):
    enc = encoding(rank_bytes(PATH), public_tokenizers.PATTERN)
    assert encode_text(enc, text, size) == encode_text(enc, text)


def test_rank_file_size_is_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr("recordloom.llm.byte_bpe.MAX_RANK_BYTES", 10)
    file = tmp_path / "ranks"
    file.write_bytes(b"x" * 11)
    with pytest.raises(ValueError):
        rank_bytes(str(file))


def brute_counts(enc, texts, rule):
    whole = "".join(texts).encode()
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    counts, at = [0.0] * len(texts), 0
    for token in enc.encode_ordinary("".join(texts)):
        end = at + len(enc.decode_single_token_bytes(token))
        held = [max(0, min(end, bounds[i + 1]) - max(at, bounds[i])) for i in range(len(texts))]
        if rule == "start":
            counts[next(i for i, h in enumerate(held) if h)] += 1
        elif rule == "majority":
            counts[held.index(max(held))] += 1
        else:
            counts = [c + h / (end - at) for c, h in zip(counts, held)]
        at = end
    assert at == len(whole)
    return counts


@pytest.mark.parametrize("rule", ["start", "majority", "share"])
def test_section_counts(spark, enc, rule):
    rows = section_tokens(docs(spark), field_sections(["source", "lang", "text"]), PATH, rule=rule).collect()
    assert len(rows) == 3 * len(cases())
    got = sorted((str(r["doc_id"]), r["section_no"], round(r["n_tokens"], 6)) for r in rows)
    want = []
    for doc_id, text, lang, source, _ in cases():
        texts = [(source or "") + "\n", (lang or "") + "\n", text or ""]
        want += [(str(doc_id), i, round(c, 6)) for i, c in enumerate(brute_counts(enc, texts, rule))]
    assert got == sorted(want)
    assert section_tokens(docs(spark, []), field_sections(["text"]), PATH).count() == 0


@pytest.mark.parametrize("rule", ["start", "majority", "share"])
def test_sentence_counts(spark, enc, rule):
    """Spaces before words make tokens that cross from sentence to sentence."""
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(["One. Two.\nThree!\n\nFour?\nfive", "", None, "\n", "a.\n", "\n\n.\n\n\n\nb", "\n\nx. y" * 60, "é! Ünd. 😀? ja. "])]
    got = section_tokens(docs(spark, rows), sentence_sections(["lang"], "text"), PATH, rule=rule).collect()
    got = sorted((r["doc_id"], r["section_no"], r["name"], round(r["n_tokens"], 6), r["doc_tokens"]) for r in got)
    want, crossed = [], 0
    for doc_id, text, *_ in rows:
        texts = ["en\n", ""]
        for i, c in enumerate(text or ""):
            texts[-1] += c
            if c == "\n" or (c == " " and i and text[i - 1] in ".!?"):
                texts.append("")
        counts, tokens = brute_counts(enc, texts, rule), len(enc.encode_ordinary("".join(texts)))
        crossed += tokens != sum(len(enc.encode_ordinary(t)) for t in texts)
        want += [(doc_id, i, "sentence" if i else "lang", round(c, 6), tokens) for i, c in enumerate(counts)]
    assert got == want
    assert crossed >= 3


def test_tokens_over_several_sections():
    ends, bounds = np.array([10]), np.array([0, 2, 2, 8, 10])
    assert attribute(ends, bounds, "start").tolist() == [1, 0, 0, 0]
    assert attribute(ends, bounds, "majority").tolist() == [0, 0, 1, 0]
    assert np.allclose(attribute(ends, bounds, "share"), [0.2, 0, 0.6, 0.2])
