"""Byte-level BPE: text to token ids and back to the very bytes.

Ids travel as packed little-endian unsigned 32-bit integers, which is what token stores keep.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.registry import query
from recordloom.llm.shared import read, short_batches

RANKS = "byte_bpe_50k.tiktoken"
#: Texts longer than this many characters are cut at safe places before they are encoded.
CHUNK = 50_000
#: A rank file is sent to every task, so its size is checked.
MAX_RANK_BYTES = 32 * 1024 * 1024
#: Between these characters no match of the pattern can reach over: a space begins after something
#: else, or the kind of character changes (not after an apostrophe, which may begin a contraction).
SAFE = regex.compile(
    r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
)


def rank_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"rank file over {MAX_RANK_BYTES} bytes")
    return data


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    """The tiktoken encoding of a rank file; built once per Python worker."""
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
    name = hashlib.sha256(ranks).hexdigest()[:12]
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def safe_chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cut a text where the pattern cannot match across, so the pieces' ids are the whole's ids.

    Each piece ends at the first safe place after ``size`` characters; without one, at the end.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str | None, size: int = CHUNK) -> bytes:
    if not text:
        return b""
    return b"".join(np.asarray(enc.encode_ordinary(part), "<u4").tobytes() for part in safe_chunks(text, size))


def decode_ids(enc, ids: bytes | None, size: int = CHUNK) -> bytes:
    if not ids:
        return b""
    numbers = np.frombuffer(ids, "<u4")
    return b"".join(enc.decode_bytes(numbers[i : i + size].tolist()) for i in range(0, len(numbers), size))


def _mapped(df: DataFrame, column: str, out: str, path: str, pattern: str, one) -> DataFrame:
    """Add ``out``, made from ``column`` by ``one(encoding, value)``, to every row."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_bytes(path))

    def rows(batches):
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                values = pa.array([one(enc, x.as_py()) for x in part.column(column)], pa.binary())
                names = [n for n in part.schema.names if n not in (column, out)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), values], [*names, out])

    kept = [f"`{n}` {t}" for n, t in df.dtypes if n not in (column, out)]
    return short_batches(df).mapInArrow(rows, ", ".join([*kept, f"`{out}` binary"]))


def encode(
    df: DataFrame, path: str, text: str = "text", out: str = "ids", pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """Replace ``text`` by ``out``: its ids, packed; every row alone, so nothing is shuffled.

    Null and empty texts have no ids. A column already called ``out`` is replaced. Long
    texts are encoded piece by piece; a run without a safe place is one piece.
    """
    return _mapped(df, text, out, path, pattern, encode_text)


def decode(
    df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """Replace packed ``ids`` by the bytes they stand for, which need not be whole characters.

    Null ids count as none. An id outside the rank file is an error.
    """
    return _mapped(df, ids, out, path, pattern, decode_ids)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the bytes decoded from them."""
    ids = encode(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path)
    digests = ids.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "ids",
    )
    return decode(digests, path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(read(spark, folder, "documents"), public_tokenizers.path(RANKS))
