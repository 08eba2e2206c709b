"""URL rules held in a cascade of Bloom filters.

The first level encodes the listed keys. The keys of the corpus that it takes for listed by
mistake go into the second level, listed keys that the second level takes for mistakes go
into the third, and so on until no mistake is left. For every key of the corpus the answer is
then exact, from a few bits per listed key and without a join. The first level is sized so that
the second has fewer keys than the list, whatever the corpus; each later one halves the mistakes.
So the bits grow with the list, and with the corpus by its logarithm only.
"""

from __future__ import annotations

import math
import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.registry import query
from recordloom.llm.shared import keep, read

#: The levels go to every task and row as values, so their bits are bounded; beyond, keys are joined.
MAX_BITS = 2**21
#: No level is smaller, so that the last few mistakes do not take a level each.
MIN_BITS = 1024


def level_bits(n: int, rate: float) -> int:
    """Bits of a level of ``n`` keys that takes a share ``rate`` of others by mistake."""
    return max(MIN_BITS, math.ceil(n * -math.log2(rate) / math.log(2) / 64) * 64)


def level_hashes(n: int, bits: int, rate: float) -> int:
    """The fewest places per key that keep mistakes at ``rate``; they are computed for every key that is looked up."""
    best = max(1, round(bits / n * math.log(2)))
    return next((k for k in range(1, best) if (1 - math.exp(-k * n / bits)) ** k <= rate), best)


class Cascade:
    """Bloom filter levels over a universe of keys; ``holds(key)`` is exact for its keys.

    ``listed`` and ``universe`` are one-column tables ``key`` of distinct strings without null.
    ``attach`` adds the levels' bits to a table, one value for all rows, which ``holds`` reads.
    ``rate`` is the share of mistakes of the first level, by default sqrt(1/2) times listed by
    universe. If the levels need more than ``max_bits`` together, none is built any more and ``fits`` is false.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, rate: float | None = None, max_bits: int = MAX_BITS):
        self.name = uuid.uuid4().hex[:8]
        self.levels: list[tuple[Column, int, int]] = []
        self.bits, self.fits = 0, True
        n = listed.count()
        if rate is None:
            rate = min(0.5, math.sqrt(0.5) * max(n, 1) / max(universe.count(), 1))
        inside, outside = listed, universe.join(listed, "key", "left_anti")
        while n or not self.levels:
            self.bits += level_bits(max(n, 1), rate)
            if self.bits > max_bits:
                self.fits = False
                return
            self.levels.append(self._level(inside, max(n, 1), rate))
            wrong = self.attach(outside).filter(self._in(F.col("key"), len(self.levels) - 1)).select("key")
            wrong = keep(wrong, "url-wrong")
            inside, outside, n, rate = wrong, inside, wrong.count(), 0.5

    def _level(self, keys: DataFrame, n: int, rate: float) -> tuple[Column, int, int]:
        bits = level_bits(n, rate)
        hashes = level_hashes(n, bits, rate)
        place = F.explode(self._places(F.col("key"), len(self.levels), bits, hashes)).alias("place")
        one = F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit")
        words = keys.select(place).select(F.expr("cast(place div 64 as int)").alias("at"), one)
        words = words.groupBy("at").agg(F.bit_or("bit").alias("word"))
        every = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("at"), "left")
        every = every.select("id", F.coalesce("word", F.lit(0)).alias("word"))
        packed = every.agg(F.array_sort(F.collect_list(F.struct("id", "word"))).alias("all")).select(F.col("all.word"))
        return keep(packed, "url-level").scalar(), bits, hashes

    def attach(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_{self.name}_{i}": words for i, (words, *_) in enumerate(self.levels)})

    @staticmethod
    def _places(key: Column, level: int, bits: int, hashes: int) -> Column:
        half = F.lit(2**31).cast("long")
        first = F.pmod(F.xxhash64(key, F.lit(level)), half)
        step = F.pmod(F.xxhash64(key, F.lit(level), F.lit("step")), half)
        return F.array(*[F.pmod(first + step * i, F.lit(bits)) for i in range(hashes)])

    def _in(self, key: Column, level: int) -> Column:
        _, bits, hashes = self.levels[level]
        words = F.col(f"_{self.name}_{level}")

        def is_set(place):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            return F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1

        return F.forall(self._places(key, level, bits, hashes), is_set)

    def holds(self, key: Column) -> Column:
        answer = F.lit(False)
        for level in reversed(range(len(self.levels))):
            answer = self._in(key, level) & ~answer
        return answer


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _candidates(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """Every key that could be a rule for the url, as (size, host_size, key)."""
    parts = F.split(host, "[.]")
    n = F.size(parts)
    starts = F.sequence(F.greatest(n - labels + 1, F.lit(1)), n)
    suffixes = F.transform(starts, lambda i: F.array_join(F.slice(parts, i, n), "."))
    suffixes = F.when(host != "", suffixes).otherwise(F.array().cast("array<string>"))
    sizes = F.filter(F.array(*map(F.lit, lengths)), lambda x: x <= F.char_length(path))

    def of(suffix, size):
        key = F.concat(suffix, F.substring(path, F.lit(1), size))
        return F.struct(F.char_length(key).alias("size"), F.char_length(suffix).alias("host_size"), key.alias("key"))

    return F.flatten(F.transform(suffixes, lambda s: F.transform(sizes, lambda x: of(s, x))))


def judge_urls(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow",
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all hosts
    below it, if the url's path starts with the rule's; the longest (then the one with the
    longer host) wins, and without one the verdict is ``default`` with a null rule. Of equal
    rules, block wins. A null url, or one without ``://``, has an empty host and no rule.
    Rules with a null host or path are left out. Every row of ``pages`` gives one row.

    One cascade over all keys that the corpus can ask for tells which are rules; a second
    over the rules tells which of them allow. Too many rules for that (``max_bits``) are
    found by a shuffled join of the keys, with the same result.
    """
    rules = rules.filter("host is not null and path is not null").select(
        F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"), "verdict",
        F.char_length("path").alias("size"), F.size(F.split("host", "[.]")).alias("labels"),
    )
    rules = keep(rules.groupBy("key", "size", "labels").agg(F.max("verdict").alias("verdict")), "url-rules")
    n, lengths, labels = rules.agg(F.count("*"), F.collect_set("size"), F.max("labels")).first()
    urls = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    keys = _candidates(F.col("host"), F.col("path"), sorted(lengths), labels or 0)
    if not n:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if level_bits(n, 0.5) > max_bits:  # the least that a list of this size takes
        return _joined(urls, rules, keys, default)
    listed = rules.select("key")
    universe = keep(urls.select(F.explode(keys).alias("k")).select("k.key").distinct(), "url-keys")
    is_rule = Cascade(listed, universe, max_bits=max_bits)
    allows = Cascade(rules.filter("verdict = 'allow'").select("key"), listed, max_bits=max_bits)
    if not (is_rule.fits and allows.fits):
        return _joined(urls, rules, keys, default)
    found = allows.attach(is_rule.attach(urls)).withColumn("best", F.array_max(F.filter(keys, lambda k: is_rule.holds(k["key"]))))
    rule = F.col("best.key")
    verdict = F.when(rule.isNull(), F.lit(default)).when(allows.holds(rule), "allow").otherwise("block")
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _joined(urls: DataFrame, rules: DataFrame, keys: Column, default: str) -> DataFrame:
    places = urls.select("host", "path").distinct()
    hits = places.select("*", F.explode(keys).alias("k")).join(rules, F.col("k.key") == rules["key"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct("k.size", "k.host_size", rules["key"], "verdict")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


@query(
    "op10_url_filter",
    """
    with rules(verdict, host, path) as (values
      ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
    u as (
      select page_id,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
      from pages),
    best as (
      select u.*, r.host || r.path as rule, r.verdict as said,
        row_number() over (partition by page_id order by length(r.host || r.path) desc nulls last, length(r.host) desc) as n
      from u left join rules r
        on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path))
    select page_id, host, path, rule, coalesce(said, 'allow') as verdict from best where n = 1
    """,
)
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(read(spark, folder, "pages"), rules)
