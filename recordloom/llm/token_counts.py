"""Tokens per section: encode whole documents once, then join token spans to section spans.

Tokens of parts do not add up to tokens of the whole, as a token may reach over a boundary. So
the whole is encoded, every token keeps its place, and both kinds of spans, which are sorted,
are joined by place.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.byte_bpe import RANKS, encoding, rank_bytes, safe_chunks
from recordloom.llm.registry import query
from recordloom.llm.shared import read, short_batches

RULES = ("start", "majority", "share")
HEADER = ("source", "lang")


@lru_cache(maxsize=4)
def token_sizes(ranks: bytes) -> np.ndarray:
    """Bytes of every token, by id."""
    pairs = [line.split() for line in ranks.splitlines() if line]
    sizes = np.zeros(max(int(rank) for _, rank in pairs) + 1, np.int64)
    for token, rank in pairs:
        sizes[int(rank)] = len(base64.b64decode(token))
    return sizes


def token_ends(enc, sizes: np.ndarray, text: str) -> np.ndarray:
    """Where each token of ``text`` ends, in bytes of its UTF-8."""
    ids = [np.asarray(enc.encode_ordinary(part), np.int64) for part in safe_chunks(text)]
    return np.cumsum(sizes[np.concatenate(ids)])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section. ``bounds``: where sections begin, and the end of the last, in bytes.

    Sections lie side by side. A token inside one counts there. One that crosses a boundary
    goes to the section of its first byte (``start``), to the one that holds most of it, the
    earlier one if two do (``majority``), or to each by its part (``share``).
    """
    sections = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    inside = first == last
    counts = np.bincount(first[inside], minlength=sections).astype(float)

    def add(section, n):
        counts[:] += np.bincount(section, n, sections)

    two = np.flatnonzero(last == first + 1)
    left, right = first[two], last[two]
    before, after = bounds[right] - starts[two], ends[two] - bounds[right]
    if rule == "share":
        add(left, before / (before + after))
        add(right, after / (before + after))
    else:
        add(left if rule == "start" else np.where(before >= after, left, right), np.ones(len(two)))
    for t in np.flatnonzero(last > first + 1):  # a token over a whole section and more
        here = np.arange(first[t], last[t] + 1)
        parts = np.minimum(bounds[here + 1], ends[t]) - np.maximum(bounds[here], starts[t])
        if rule == "start":
            counts[first[t]] += 1
        elif rule == "majority":
            counts[here[np.argmax(parts)]] += 1
        else:
            np.add.at(counts, here, parts / parts.sum())
    return counts


def section_tokens(
    docs: DataFrame, sections: Column, path: str, doc_id: str = "doc_id", rule: str = "majority", chunk: int = 64,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """One row per section of every row: doc_id, section_no, name, start, end, n_tokens, doc_tokens.

    ``sections`` is an array of (name, text): a document is its sections' texts one after the
    other, encoded as one. ``start`` and ``end`` are characters of that document. ``rule`` says
    where a token that crosses a boundary counts; see ``attribute``. The counts of a document
    add up to ``doc_tokens``. Null texts are empty sections with no tokens; a row with a null or
    empty array gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(rank_bytes(path))
    names = ["doc_id", "section_no", "name", "start", "end", "n_tokens", "doc_tokens"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoding(ranks.value, pattern), token_sizes(ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part, out = batch.slice(at, chunk), []
                for i, found in zip(part.column("doc_id").to_pylist(), part.column("sections")):
                    texts = [(s["name"], s["text"] or "") for s in found.as_py() or []]
                    ends = token_ends(enc, sizes, "".join(t for _, t in texts))
                    bounds = np.cumsum([0] + [len(t.encode()) for _, t in texts])
                    counts = attribute(ends, bounds, rule)
                    start = 0
                    for n, (name, text) in enumerate(texts):
                        out.append((i, n, name, start, start + len(text), float(counts[n]), len(ends)))
                        start += len(text)
                types = [part.schema.field("doc_id").type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                columns = list(zip(*out)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    named = docs.select(F.col(doc_id).alias("doc_id"), sections.alias("sections"))
    kind = dict(named.dtypes)["doc_id"]
    return short_batches(named).mapInArrow(
        rows, f"doc_id {kind}, section_no int, name string, start long, end long, n_tokens double, doc_tokens long"
    )


def field_sections(fields: Iterable[str]) -> Column:
    """Fields of a row as sections, each but the last with a line break after it."""
    *others, last = fields
    texts = [(f, F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\n"))) for f in others]
    texts.append((last, F.coalesce(F.col(last).cast("string"), F.lit(""))))
    return F.array(*[F.struct(F.lit(f).alias("name"), t.alias("text")) for f, t in texts])


#: A sentence ends after a mark and one space, or after a line break; both stay with it.
SENTENCE_ENDS = r"(?<=[.!?] )|(?<=\n)"


def sentence_sections(header: Iterable[str], text: str) -> Column:
    """Header fields, each with a line break after it, then the text's sentences, which together are the whole text.

    The space before a word belongs to the word's token but to the sentence before, so tokens cross there.
    """
    fields = [F.struct(F.lit(f).alias("name"), F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\n")).alias("text")) for f in header]
    sentences = F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE_ENDS)
    parts = F.transform(sentences, lambda s: F.struct(F.lit("sentence").alias("name"), s.alias("text")))
    return F.concat(F.array(*fields), parts) if fields else parts


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The header fields and the sentences of every document, encoded as one."""
    docs = read(spark, folder, "documents")
    return section_tokens(docs, sentence_sections(HEADER, "text"), public_tokenizers.path(RANKS))
