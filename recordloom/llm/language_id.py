"""Language of pages by fusing evidence: text, declared language, address suffix and host.

log P(language | page) = text likelihood + log P(declared | language) + log P(suffix | language)
+ log prior of the host, up to a constant. What a declaration or a suffix says about a language
and what a host mostly holds are counted over all pages by what their texts say; the
prior of a host is drawn to that of its domain, and that to the corpus's, by pseudo-counts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.registry import query
from recordloom.llm.shared import join_counted, keep, read, short_batches
from recordloom.llm.url_filter import url_host

#: Bounds of what the text model is fitted on: about so many labelled documents, by a hash of the id.
SAMPLE_ROWS = 20_000
#: Character trigrams (of UTF-8 bytes) are counted in so many places.
PLACES = 2**14
#: Trigrams follow from each other; a text counts as at most so many independent ones.
EVIDENCE = 100.0
#: Pseudo-counts: of trigrams, of what is declared, and of the parent's prior.
SMOOTH_TEXT, SMOOTH_SAID, SMOOTH_PRIOR = 0.5, 1.0, 20.0

_MARKUP = re.compile(r"(?i)<(?:(script|style)\b|(!--))?")
_ENDS = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")} | {"!--": re.compile("-->")}
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b"


def visible(page: str | None) -> str:
    """The text outside tags, comments, scripts and styles, each of which counts as a blank.

    A script or comment that is not closed is a tag like others, and a tag that is not closed is
    text. What was looked for in vain once is not looked for again, so a page is read a bounded
    number of times, whatever it holds.
    """
    page, out, at, missing = page or "", [], 0, set()
    while (m := _MARKUP.search(page, at)) is not None:
        kind = (m[1] or m[2] or "").lower()
        end = None
        if kind and kind not in missing:
            end = _ENDS[kind].search(page, m.end())
            if end is None:
                missing.add(kind)
        close = end.end() if end else page.find(">", m.start()) + 1
        if not close:
            break
        out += [page[at : m.start()], " "]
        at = close
    return html.unescape("".join([*out, page[at:]]))


def trigram_counts(text: str | None) -> np.ndarray:
    """How often the text's trigrams fall in each place; letters in lower case, other runs one space."""
    letters = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    raw = np.frombuffer(f" {letters} ".encode() if letters else b"", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(PLACES)
    codes = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    places = (codes * np.uint32(2654435761)) >> np.uint32(18)
    return np.bincount(places, minlength=PLACES).astype(float)


class TextModel:
    """``languages`` in order, and log P(place | language) for each."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def likelihoods(self, text: str | None) -> np.ndarray:
        counts = trigram_counts(text)
        total = counts.sum()
        return self.weights @ counts * (min(1.0, EVIDENCE / total) if total else 0.0)


def fit_text(docs: DataFrame, rows: int = SAMPLE_ROWS) -> TextModel:
    """Trigram frequencies per ``lang`` of about ``rows`` documents of ``docs`` (doc_id, text, lang) at most."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null")
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                sums[lang] = sums.get(lang, 0) + trigram_counts(text.as_py())
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at].astype(int), pa.int64())],
                ["lang", "place", "n"],
            )

    sums = short_batches(chosen.select("lang", "text")).mapInArrow(count, "lang string, place int, n long")
    # languages times PLACES rows at most
    got = sums.groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in got})
    counts = np.full((len(languages), PLACES), SMOOTH_TEXT)
    for r in got:
        counts[languages.index(r["lang"]), r["place"]] += r["n"]
    return TextModel(languages, np.log(counts / counts.sum(1, keepdims=True)))


def page_evidence(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, host, domain, suffix, declared, text (log likelihoods by language) and said (the best, or null)."""
    host = url_host(F.col(url))
    parts = F.split(host, "[.]")
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(page), F.lit("")), DECLARED, 1))
    rows = pages.select(
        F.col(page_id).alias("page_id"), host.alias("host"),
        F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".").alias("domain"),
        F.element_at(parts, -1).alias("suffix"), declared.alias("declared"), F.col(page).alias("html"),
    )
    sent = pages.sparkSession.sparkContext.broadcast(model)  # languages times PLACES numbers

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, said = [], []
            for value in batch.column("html"):
                found = sent.value.likelihoods(visible(value.as_py()))
                text.append(found.tolist())
                said.append(int(found.argmax()) if found.any() else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(text, pa.list_(pa.float64())), pa.array(said, pa.int32())],
                [*batch.schema.names[:-1], "text", "said"],
            )

    kept = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])
    return short_batches(rows).mapInArrow(score, f"{kept}, text array<double>, said int")


def _votes(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Per value of ``key``: rows n, and votes of each language. Partial sums, so a hot value does no harm."""
    per = [F.count(F.when(F.col("said") == i, 1)).cast("double") for i in range(size)]
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array(*per).alias("votes"))


def fuse_languages(
    pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """Per page: page_id, lang, confidence, text_lang, declared, host, suffix.

    A page's own vote is left out of its host's and domain's. Without text the other evidence
    decides, without a url the prior is the corpus's; an empty declaration or suffix counts like
    any other value. Null html and url count as empty. Ties go to the first language by name.
    With no language to choose from, lang and text_lang are null.
    """
    size, names = len(model.languages), F.array(*map(F.lit, model.languages)).cast("array<string>")
    if not size:
        host = url_host(F.col(url))
        none = F.lit(None).cast("string")
        return pages.select(
            F.col(page_id).alias("page_id"), none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"),
            F.lit("").alias("declared"), host.alias("host"), F.element_at(F.split(host, "[.]"), -1).alias("suffix"),
        )
    rows = keep(page_evidence(pages, model, page_id, url, page), "language-evidence")
    all_votes = _votes(rows.withColumn("all", F.lit(0)), "all", size).first()
    votes = np.array(all_votes["votes"] if all_votes else [0.0] * size)
    corpus = F.array(*[F.lit(float(x)) for x in (votes + SMOOTH_SAID) / (votes.sum() + size * SMOOTH_SAID)])
    totals = F.array(*[F.lit(float(x)) for x in votes])

    def drawn(votes: Column, own: Column, parent: Column) -> Column:
        """The share of each language, drawn to ``parent``, without the page's own vote."""
        others = F.transform(votes, lambda v, i: v - F.when(own == i, 1.0).otherwise(0.0))
        n = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(others, parent, lambda v, p: (v + p * SMOOTH_PRIOR) / (n + SMOOTH_PRIOR))

    def said_by(key: str) -> DataFrame:
        """For every value of ``key`` the votes of its pages, ``n`` of them."""
        return keep(_votes(rows, key, size), f"language-{key}").select(key, "n", F.col("votes").alias(f"by_{key}"))

    def told_by(votes: str, kinds: int) -> Column:
        """log P(value | language), smoothed over its ``kinds`` of values, without the page's own vote."""

        def one(v, t, i):
            own = F.when(F.col("said") == i, 1.0).otherwise(0.0)
            return F.log((v - own + SMOOTH_SAID) / (t - own + kinds * SMOOTH_SAID))

        both = F.arrays_zip(F.col(votes).alias("v"), totals.alias("t"))
        return F.transform(both, lambda x, i: one(x["v"], x["t"], i))

    hosts = keep(_votes(rows, "host", size).withColumnRenamed("votes", "host_votes"), "language-hosts")
    domains = keep(_votes(rows, "domain", size).withColumnRenamed("votes", "domain_votes"), "language-domains")
    told = join_counted(rows, hosts, ["host"], "n", ["page_id"]).drop("n")
    told = join_counted(told, domains, ["domain"], "n", ["page_id"]).drop("n")
    # at most some 18,000 values of two or three letters, and one for none
    declared, suffixes = said_by("declared"), said_by("suffix")
    told = told.join(F.broadcast(declared.drop("n")), "declared")
    told = join_counted(told, suffixes, ["suffix"], "n", ["page_id"])

    prior = drawn(F.col("host_votes"), F.col("said"), drawn(F.col("domain_votes"), F.col("said"), corpus))
    prior = F.when(F.col("host") == "", corpus).otherwise(prior)
    known = F.arrays_zip(F.col("text").alias("t"), told_by("by_declared", declared.count()).alias("d"), told_by("by_suffix", suffixes.count()).alias("s"), prior.alias("p"))
    told = told.withColumn("score", F.transform(known, lambda x: x["t"] + x["d"] + x["s"] + F.log(x["p"])))
    top = F.array_max("score")
    mass = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))
    best = F.array_position("score", top).cast("int")
    return told.select(
        "page_id", F.element_at(names, best).alias("lang"), (1 / mass).alias("confidence"),
        F.get(names, F.col("said")).alias("text_lang"), "declared", "host", "suffix",
    )


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    model = fit_text(read(spark, folder, "documents"))
    return fuse_languages(read(spark, folder, "pages"), model)
