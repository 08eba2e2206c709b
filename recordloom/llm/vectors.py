"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codebooks and pivots are fitted on so many distinct vectors at most, chosen by a hash.
SAMPLE = 4_096


def usable(vector: Column) -> Column:
    """Not null, not empty, and all components present and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def not_zero(vector: Column) -> Column:
    return F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def lengths(vectors: DataFrame, least: int = 1) -> list[int]:
    """The lengths that ``least`` rows or more have, from a grouped count over all rows: a number per length."""
    counts = vectors.groupBy(F.size("vector").alias("length")).count().filter(F.col("count") >= least)
    return sorted(r["length"] for r in counts.collect())


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists that have one length."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def sample(vectors: DataFrame, by: str, n: int = SAMPLE) -> np.ndarray:
    """At most ``n`` vectors, the first by a hash of ``by``; the same for every run. One length only."""
    few = vectors.select("vector", by).orderBy(F.xxhash64(by, F.lit("sample")), by, "vector").limit(n).collect()
    return np.array([r["vector"] for r in few], float)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows from all centres."""
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * (x @ centres.T), 0)


def centres_of(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """At most ``k`` distinct centres of the rows of ``x``, a bounded sample, by Lloyd's rounds."""
    some = np.unique(x, axis=0)
    centres = some[np.random.default_rng(11).permutation(len(some))[:k]]
    for _ in range(rounds):
        near = squared_distances(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return np.unique(centres, axis=0)
