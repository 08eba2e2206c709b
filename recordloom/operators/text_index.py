"""Free-text search by trigram postings: where a needle can be, before any text is read.

Every run of three characters of a field, in lower case, is posted with the row's key and the field.
A text that holds a needle holds all its trigrams, so rows that lack one of them are out; what
is left is tested on the text itself. Postings lie in buckets by trigram, and a search reads
those of its rarest trigrams only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import let
from recordloom.operators.match import keep
from recordloom.operators.quality import search
from recordloom.operators.scale import small_or_shuffled

GRAM = 3
BUCKETS = 64
#: A search intersects the postings of so many trigrams, the rarest of the needle.
RAREST = 6
#: Keys of candidates that may be broadcast to fetch their rows.
MAX_CANDIDATES = 500_000


def grams_of(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none for shorter and null texts."""
    last = F.char_length(text) - GRAM + 1

    def runs(characters: Column) -> Column:
        # characters by place, as a substring would be looked for from the start of the text each time
        run = F.transform(characters, lambda c, i: F.concat(c, *[F.get(characters, i + k) for k in range(1, GRAM)]))
        return F.array_distinct(F.filter(run, lambda r: r.isNotNull()))

    return F.when(last >= 1, let(F.split(F.lower(text), ""), runs)).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_text_index(df: DataFrame, key: str, columns: Sequence[str], path: str) -> TextIndex:
    """Post the ``columns`` of ``df``, whose ``key`` is unique and not null, below ``path``."""
    fields = F.array(*[F.struct(F.lit(i).alias("field"), grams_of(F.col(c)).alias("grams")) for i, c in enumerate(columns)])
    posted = df.select(key, F.explode(fields).alias("f")).select(key, "f.field", F.explode("f.grams").alias("gram"))
    posted = keep(posted.withColumn("bucket", _bucket(F.col("gram"))), "text-postings")  # ranges are sampled from it
    # a bucket with a frequent trigram is split over several files; inside, postings are sorted, so files can be skipped
    posted.repartitionByRange("bucket", "gram", key).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = df.sparkSession.read.schema(posted.schema).parquet(f"{path}/postings")
    counts = stored.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
    return TextIndex(df.sparkSession, path, key, columns)


class TextIndex:
    """Postings as written by ``write_text_index``, for rows with the same ``key`` and ``columns``."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: Sequence[str]) -> None:
        self.spark, self.path, self.key, self.columns = spark, path, key, list(columns)

    def _of(self, table: str, grams: Sequence[str]) -> DataFrame:
        """The rows of some trigrams, from their buckets alone."""
        few = self.spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _bucket(F.col("gram")).alias("bucket"))
        buckets = sorted({r["bucket"] for r in few.collect()})  # as many as the needle has trigrams
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        return rows.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(list(grams)))

    def candidates(self, needle: str) -> DataFrame | None:
        """Distinct keys of rows with a field that holds the needle's rarest trigrams; None if it is too short to have one."""
        low = self.spark.range(1).select(grams_of(F.lit(needle)).alias("g")).first()["g"]
        if not low:
            return None
        counts = {r["gram"]: r["n"] for r in self._of("counts", low).collect()}
        rarest = sorted(low, key=lambda g: (counts.get(g, 0), g))[:RAREST]
        hits = self._of("postings", rarest).groupBy(self.key, "field").agg(F.count("*").alias("n"))
        return hits.filter(F.col("n") == len(rarest)).select(self.key).distinct()

    def search(self, df: DataFrame, needle: str) -> DataFrame:
        """What ``quality.search`` returns: rows of ``df`` with ``needle`` in one of the columns, whatever the case.

        Needles under three characters have no trigram, and every row is tested.
        """
        found = self.candidates(needle)
        if found is None:
            return search(df, needle, self.columns)
        keys = small_or_shuffled(keep(found, "text-candidates"), MAX_CANDIDATES)
        return search(df.join(keys, self.key, "left_semi"), needle, self.columns)
