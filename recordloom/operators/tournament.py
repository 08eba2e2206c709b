"""The best k of every unit by comparing two records at a time, in rounds.

For judges that can say which of two records suits a unit better, but give no score. All units go
through the same rounds. In a round every open segment of a unit's order draws a few pivots,
each of its records meets those pivots, and what beats how many of them says which part of the
segment it belongs to. Segments that begin at place k or later are dropped unsorted. So a round
compares each open record with ``pivots`` others, and the number of rounds grows with the
logarithm of the longest list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import scores as S
from recordloom.operators.match import FINAL_K, keep
from recordloom.operators.scale import skew_join, top_k

PIVOTS = 4


def more_shared_words(one: Column, other: Column, unit: Column) -> Column:
    """The built-in judge, over words: the record that holds more of the unit's words is better."""
    return S.token_overlap(one, unit) - S.token_overlap(other, unit)


def top_k_by_comparison(
    candidates: DataFrame,
    key: str,
    unit: str,
    record: str = "_record",
    statement: str = "_unit",
    k: int = FINAL_K,
    better: Callable[[Column, Column, Column], Column] = more_shared_words,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(unit, key, rank, compared): places 1..k of every unit, and how many comparisons its list took.

    ``better(one, other, statement)`` is a column function or Pandas UDF: above 0 where ``one``
    suits the statement better, below 0 where ``other`` does; at 0 or null the smaller key goes
    first. For a judge whose verdicts form an order the result is the head of that order. (unit,
    key) is unique; candidates with a null key or unit take no part.
    """
    contents = keep(candidates.filter(F.col(unit).isNotNull() & F.col(key).isNotNull()).select(unit, key, record, statement), "tournament-contents")
    # ``place`` is where a record's segment begins, counted from 0; alone in its segment it has its final place
    state = contents.select(unit, key, F.lit(0).cast("long").alias("place"))
    segment = [unit, "place"]
    done, compared, round_ = [], [], 0
    while True:
        sizes = state.groupBy(*segment).agg(F.count("*").alias("size"))
        # of a hot unit's segment there is one row on the right
        state = keep(skew_join(state, sizes, segment, [key], "inner"), f"tournament-{round_}")
        done.append(state.filter(f"size = 1 and place < {int(k)}").select(unit, key, "place"))
        open_ = state.filter(f"size > 1 and place < {int(k)}").drop("size")
        if open_.isEmpty():
            break
        drawn = top_k(open_, segment, [F.xxhash64(key, F.lit(round_)), F.col(key)], pivots, [key])
        drawn = keep(drawn.select(*segment, F.col(key).alias("_pivot")), "tournament-pivots")
        texts = contents.select(F.col(unit).alias("_u"), F.col(key).alias("_p"), F.col(record).alias("_other"))
        posts = drawn.join(texts, (F.col(unit) == F.col("_u")) & (F.col("_pivot") == F.col("_p"))).drop("_u", "_p")
        lists = posts.groupBy(*segment).agg(F.collect_list(F.struct("_pivot", "_other")).alias("_posts"))  # ``pivots`` of them
        meet = skew_join(open_.join(contents, [unit, key]), lists, segment, [key], "inner").withColumn("_post", F.explode("_posts"))
        verdict = F.coalesce(better(F.col(record), F.col("_post._other"), F.col(statement)).cast("double"), F.lit(0.0))
        met = meet.select(*segment, key, F.col("_post._pivot").alias("_pivot"), verdict.alias("_verdict"))
        own = F.col(key) == F.col("_pivot")
        behind = ~own & ((F.col("_verdict") < 0) | ((F.col("_verdict") == 0) & (F.col("_pivot") < F.col(key))))
        part = met.groupBy(*segment, key).agg(
            F.count_if(behind).alias("_part"), F.max(own.cast("int")).alias("_drawn"), F.count_if(~own).alias("_met")
        )
        part = keep(part, "tournament-parts")
        compared.append(part.groupBy(unit).agg(F.sum("_met").alias("compared")))
        # a part holds what no more pivots beat, then the pivot itself: at most ``pivots`` + 1 parts a segment
        sizes = part.groupBy(*segment, "_part", "_drawn").agg(F.count("*").alias("_n"))
        before = Window.partitionBy(*segment).orderBy("_part", "_drawn").rowsBetween(Window.unboundedPreceding, -1)
        begins = sizes.select(*segment, "_part", "_drawn", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        moved = skew_join(part, begins, [*segment, "_part", "_drawn"], [key], "inner")
        state = moved.select(unit, key, (F.col("place") + F.col("_before")).alias("place"))
        round_ += 1
    ranked = done[0]
    for more in done[1:]:
        ranked = ranked.unionAll(more)
    counts = state.sparkSession.createDataFrame([], contents.select(unit, F.lit(0).cast("long").alias("compared")).schema)
    for more in compared:
        counts = counts.unionAll(more)
    counts = counts.groupBy(unit).agg(F.sum("compared").alias("compared"))
    ranked = ranked.select(unit, key, (F.col("place") + 1).cast("int").alias("rank"))
    return ranked.join(counts, unit, "left").withColumn("compared", F.coalesce("compared", F.lit(0)))
