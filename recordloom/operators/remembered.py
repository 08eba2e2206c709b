"""Texts per matched pair that are made once: a stored table of results by digest of what was asked.

The digest covers the instruction, the record and the unit, so a changed record or wording is asked
anew and everything else is not. Only pairs without a stored text reach the generator. What came
back empty is not remembered, so it is tried again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import missing
from recordloom.operators.match import keep, shared_words

#: Steps of a run; each is stored when it is done, so a run that is killed loses one step at most.
STEPS = 4

DIGEST, TEXT = "_digest", "_text"


def asked(instruction: str, record: str, unit: str) -> Column:
    """Digest of a question; columns of any type, by their JSON. Lengths part the texts; null and empty differ."""
    parts = [F.lit(instruction), *[F.to_json(F.struct(F.col(c).alias("c"))) for c in (record, unit)]]
    return F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


class Remembered:
    """Generated texts below ``path``, one Parquet folder per step of a run."""

    def __init__(self, spark: SparkSession, path: str, steps: int = STEPS) -> None:
        self.spark, self.path, self.steps = spark, path, steps

    def texts(self) -> DataFrame:
        """(_digest, _text) of every text that is stored, each digest once."""
        try:
            stored = self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], f"{DIGEST} string, {TEXT} string")
        return stored.filter(~missing(F.col(TEXT))).groupBy(DIGEST).agg(F.min(TEXT).alias(TEXT))

    def annotate(
        self, matched: DataFrame, instruction: str, out: str = "recommendation_reason", record: str = "_record", unit: str = "_unit",
        generator: Callable[[Column, Column], Column] = shared_words,
    ) -> DataFrame:
        """``matched`` with a text per row, null where the generator gave none.

        Equal questions are asked once. ``record`` and ``unit`` are columns of text or of arrays,
        which the generator gets as they are; null ones are asked like any other.
        """
        rows = keep(matched.withColumn(DIGEST, asked(instruction, record, unit)), "remembered-rows")
        questions = rows.groupBy(DIGEST).agg(F.any_value(F.struct(record, unit)).alias("q")).select(DIGEST, "q.*")
        open_ = keep(questions.join(self.texts(), DIGEST, "left_anti"), "remembered-open")
        for step in range(self.steps):
            part = open_.filter(F.pmod(F.xxhash64(DIGEST), F.lit(self.steps)) == step)
            if part.isEmpty():
                continue
            # failures are written too: a filter on the generator's column could run it twice
            made = part.select(DIGEST, generator(F.col(record), F.col(unit)).alias(TEXT))
            made.write.mode("append").parquet(self.path)
        answers = self.texts().withColumnRenamed(TEXT, out)
        return rows.drop(out).join(answers, DIGEST, "left").drop(DIGEST)
