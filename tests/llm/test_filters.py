"""URL rules, toxicity and language of pages."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import url_filter
from recordloom.llm.language_id import fit_text, fuse_languages, trigram_counts, visible
from recordloom.llm.toxicity import OrdinalModel, fit_cumulative, fit_toxicity, grade_toxicity
from recordloom.llm.url_filter import RULES, Cascade, judge_urls
from tests.llm.tables import CLASH, cases, docs, words

URLS = [
    None, "", "no scheme", "://", "http://", "https://net", "https://net/", "https://a.net/x", "https://xnet/y", "HTTPS://Sub.EXAMPLE.Net/en/1?q#f",
    "https://example.net/EN/1", "https://example.com/de/", "https://example.com/de", "https://www.example.com/de/a", "https://org/fr/", "https://a.org/fr/?x",
    "https://a.org?x/fr/", "a://b://net/c", "https://.net/z", "https://a..net/z", "https://" + "a." * 500 + "net/" + "p" * 5_000, "https://é.net/ü", "https://a.net/x",
]


def brute_judge(url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if not fit:
        return host, path, None, "allow"
    best = max(fit, key=lambda r: (len(r[1] + r[2]), len(r[1])))
    return host, path, best[1] + best[2], best[0]


def pages(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def rules(spark, rows):
    return spark.createDataFrame(rows, "verdict string, host string, path string")


@pytest.mark.parametrize("max_bits", [2**21, 0])
def test_urls(spark, max_bits):
    got = judge_urls(pages(spark, URLS), rules(spark, RULES), max_bits=max_bits).collect()
    assert sorted(map(tuple, got)) == [(i, *brute_judge(u)) for i, u in enumerate(URLS)]
    assert judge_urls(pages(spark, []), rules(spark, RULES), max_bits=max_bits).count() == 0


def test_many_rules_and_no_rules(spark):
    draw = random.Random(2)
    hosts = [f"{a}.{b}" for a in "abcdefgh" for b in ("com", "net", "x.org")] + ["com", "net"]
    many = [(draw.choice(["allow", "block"]), h, p) for h in hosts for p in ("", "/", "/d", "/d/e/") if draw.random() < 0.5]
    many = list({(h, p): (v, h, p) for v, h, p in many}.values())
    urls = [f"http://{draw.choice(['', 'w.', 'v.w.'])}{draw.choice(hosts)}{draw.choice(['', '/', '/d', '/d/e/f', '/x'])}" for _ in range(400)]
    got = judge_urls(pages(spark, urls), rules(spark, many + [("block", None, "/"), ("allow", "q", None)])).collect()
    assert sorted(map(tuple, got)) == [(i, *brute_judge(u, many)) for i, u in enumerate(urls)]
    none = judge_urls(pages(spark, URLS), rules(spark, []))
    assert {(r["rule"], r["verdict"]) for r in none.collect()} == {(None, "allow")}


def test_cascade_is_exact_with_few_bits(spark):
    keys = spark.range(5_000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = Cascade(keys.filter("key like '%7'"), keys, rate=0.4)
    assert len(cascade.levels) > 3
    told = cascade.attach(keys).filter(cascade.holds(F.col("key"))).select("key")
    assert sorted(r["key"] for r in told.collect()) == sorted(f"k{i}" for i in range(7, 5_000, 10))


def test_bits_follow_the_list_and_not_the_corpus(spark):
    listed = spark.range(2_000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits = {}
    for size in (20_000, 200_000):
        keys = spark.range(size).select(F.concat(F.lit("k"), "id").alias("key"))
        cascade = Cascade(listed, keys)
        told = cascade.attach(keys).filter(cascade.holds(F.col("key")))
        assert told.count() == 2_000 and told.join(listed, "key", "left_anti").isEmpty()
        bits[size] = cascade.bits / 2_000
    assert bits[20_000] < 14 and bits[200_000] < bits[20_000] + 6
    assert not Cascade(listed, keys, max_bits=4_096).fits


def test_too_many_bits_are_joined(spark):
    many = [("block" if i % 3 else "allow", f"h{i}.net", "/a" if i % 2 else "/") for i in range(600)]
    urls = [f"http://{'w.' * (i % 3)}h{i}.net/{'a/b' if i % 5 else ''}" for i in range(900)]
    want = [(i, *brute_judge(u, many)) for i, u in enumerate(urls)]
    for max_bits in (2**21, 3_000):  # enough for the list, but not for all levels
        assert sorted(map(tuple, judge_urls(pages(spark, urls), rules(spark, many), max_bits=max_bits).collect())) == want


def test_ordinal_fit_shares_weights_over_ordered_cuts():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3_000, 2))
    score = 2.0 * x[:, 0] - 1.0 * x[:, 1] + draw.logistic(size=3_000)
    grades = (score > -1).astype(int) + (score > 1) + (score > 2)
    w, cuts = fit_cumulative([(int(g), {0: a, 1: b}) for g, (a, b) in zip(grades, x)], 2, 4, l2=1e-3)
    assert np.allclose(w, [2, -1], atol=0.2) and np.allclose(cuts, [-1, 1, 2], atol=0.2)


def labelled(spark, n=800):
    bad = ["vile", "grim", "foul"]
    rows, labels = [], []
    for i in range(n):
        text = words(i, 40 + i % 100).split()
        toxic = i % 5 == 0
        for k in range(1 + i % 4 if toxic else 0):
            text.insert(7 * k, bad[(i + k) % 3] + ("ness," if i % 2 else ""))
        rows.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    df, labels = labelled(spark)
    model = fit_toxicity(df.filter("doc_id < 500"), labels.filter("doc_id < 500"))
    got = grade_toxicity(df.filter("doc_id >= 500"), model).collect()
    assert sum(r["toxic"] == (r["doc_id"] % 5 == 0) for r in got) >= 0.98 * len(got)
    assert all(0 <= r["severity"] <= 2 and r["toxic"] == (r["p_toxic"] >= 0.5) for r in got)
    strong, weak = (np.mean([r["severity"] for r in got if r["doc_id"] % 20 == k]) for k in (15, 0))
    assert strong > weak
    again = fit_toxicity(df.filter("doc_id < 500").repartition(5), labels.filter("doc_id < 500"))
    assert again.names == model.names and np.array_equal(again.weights, model.weights)


def test_toxicity_of_the_cases(spark):
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (9, 0), (9, 0), (77, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs(spark), labels)
    assert grade_toxicity(docs(spark), model).filter("not toxic").count() == len(cases())
    assert grade_toxicity(docs(spark, []), model).count() == 0
    assert fit_toxicity(docs(spark, []), labels.limit(0)).names == {}
    assert isinstance(model, OrdinalModel)


def web(spark, n=300):
    draw = random.Random(4)
    said = {"en": "the of and to in is that for it was on with as", "de": "der die und das ist nicht mit ein auf für sich", "fr": "le la les des et est une dans pour que qui"}
    train = [(i, " ".join(draw.choices(said[x].split(), k=60)), x, "s", 1) for i, x in enumerate(sorted(said) * 40)]
    rows, truth = [], {}
    for i in range(n):
        lang = draw.choice(sorted(said)) if i % 3 else "de"
        host = "hot.example.de" if i % 3 == 0 else f"{lang}{i % 7}.example.com"
        text = "" if i % 10 == 9 else " ".join(draw.choices(said[lang].split(), k=40))
        declared = "" if i % 10 == 4 else f' lang="{lang.upper()}-x"'
        rows.append((i, f"http://{host}/{i}", f"<html{declared}><script>the of</script><p>{text}</p></html>"))
        truth[i] = lang
    return docs(spark, train), spark.createDataFrame(rows, "page_id long, url string, html string"), truth


def test_language_evidence_is_fused(spark):
    train, df, truth = web(spark)
    got = fuse_languages(df.withColumns({c: F.lit(1) for c in CLASH}), fit_text(train)).collect()
    assert len(got) == len(truth)
    assert np.mean([r["lang"] == truth[r["page_id"]] for r in got]) >= 0.99
    empty = [r for r in got if r["text_lang"] is None]
    assert len(empty) == 30 and all(r["lang"] == truth[r["page_id"]] for r in empty)  # by declaration and host
    assert all(1 / 3 <= r["confidence"] <= 1.0000001 for r in got)


def test_language_cases(spark):
    train, _, _ = web(spark)
    rows = [(1, None, None), (None, "http://a.fr/", "<p>le la les"), (2, "", ""), (3, "x", "<html lang=de>"), (3, "x", "<html lang=de>"), (4, "http://b.de", "a" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = fuse_languages(df, fit_text(train)).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows) and all(r["lang"] for r in got)
    assert fuse_languages(df.limit(0), fit_text(train)).count() == 0
    assert {r["lang"] for r in fuse_languages(df, fit_text(docs(spark, []))).collect()} == {None}


def test_visible_text():
    assert visible('<style>p{}</style><script>var t="</p>";</script><!-- x --><p>a&amp;b</p>').split() == ["a&b"]
    assert trigram_counts(None).sum() == 0 and trigram_counts("123").sum() == 0


def test_visible_text_equals_the_pattern_and_long_pages_take_no_longer():
    """One pass over the page finds what the pattern finds, also where tags, comments and scripts stay open."""
    pattern = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    draw = random.Random(2)
    bits = ["<script", "<SCRIPT x>", "</script >", "<style>", "</style", ">", "<!--", "-->", "<", "a", " b ", "<p class='x'>", "</p>", "<scripted>", "\n"]
    for _ in range(3_000):
        page = "".join(draw.choices(bits, k=draw.randint(0, 12)))
        assert visible(page) == pattern.sub(" ", page), page
    began = time.process_time()
    for bit in ("<script ", "<!--", "<", "<style>", "</script"):
        visible(bit * (1_000_000 // len(bit)))
    assert time.process_time() - began < 10


def test_a_rare_declaration_does_not_confirm_itself(spark):
    """A page's own vote counts neither for its host, nor for what it declares, nor for its suffix."""
    train, df, _ = web(spark, 90)
    alone = df.limit(0).unionAll(spark.createDataFrame([(900, "http://only.zz/1", "<html lang=qq><p>" + "the of and to in " * 3)], df.schema))
    rows = df.unionAll(alone)
    got = {r["page_id"]: r for r in fuse_languages(rows, fit_text(train)).collect()}
    # the declaration and the suffix are seen on this page alone: what is left of them says nothing
    plain = df.unionAll(spark.createDataFrame([(900, "", "<html><p>" + "the of and to in " * 3)], df.schema))
    assert got[900]["lang"] == "en" == {r["page_id"]: r for r in fuse_languages(plain, fit_text(train)).collect()}[900]["lang"]
    assert got[900]["declared"] == "qq" and got[900]["suffix"] == "zz"
