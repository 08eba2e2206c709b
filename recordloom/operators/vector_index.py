"""A stored index of vectors that searches read in part: clusters with bounds, a folder each.

Vectors of length one are dealt to the nearest of some centres and written partitioned by
cluster, beside a small table of centres, radii and row counts. A unit vector q cannot be closer to
a member of a cluster than its distance from the centre less the radius, which bounds the
cosine from above. A search reads, per unit, the clusters with the highest bounds that hold enough
rows; then only those whose bound reaches the last score found so far. The rest is left out as
partitions, before anything of it is read, and the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.match import (
    DIGITS,
    MAX_UNITS,
    SEARCH_K,
    _found,
    _found_batch,
    _Heads,
    _id_type,
    _unit_rows,
    _vectors,
    keep,
    scaled_vectors,
)
from recordloom.operators.scale import top_k
from recordloom.session import short_batches

#: Centres are fitted on so many vectors at most, chosen by a hash of their keys.
SAMPLE = 4_096
MAX_CLUSTERS = 1_024
#: What rounding of scores and distances may hide.
SLACK = 10.0**-DIGITS


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0)


def _fit_centres(x: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """At most ``clusters`` centres of the sample ``x``, by Lloyd's rounds from a fixed start."""
    some = np.unique(x, axis=0)
    centres = some[np.random.default_rng(5).permutation(len(some))[:clusters]]
    for _ in range(rounds):
        near = _squared(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


@dataclass
class VectorIndex:
    """An index as written: ``rows`` (key, vector, norm, cluster), and the clusters' centres, radii and row counts."""

    rows: DataFrame
    key: str
    vector: str
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """For unit vectors the highest cosine each cluster can hold, a row per unit."""
        apart = np.sqrt(_squared(units, self.centres))
        nearest = np.maximum(apart - self.radii - SLACK, 0)
        return np.where(self.counts > 0, 1 - nearest**2 / 2, -np.inf)

    def clusters(self, wanted: np.ndarray) -> DataFrame:
        """The rows of the clusters for which ``wanted`` holds; the others are not listed, opened or read."""
        return self.rows.filter(F.col("cluster").isin(np.flatnonzero(wanted).tolist()))

    def search(self, units: DataFrame, unit: str, vector: str, k: int = SEARCH_K, max_units: int = MAX_UNITS) -> DataFrame:
        """(unit, key, score, rank): the k most similar rows per unit by cosine, ties by key, as ``match.search``.

        Ids of units are unique. More than ``max_units`` units are taken in blocks.
        """
        unit_type = _id_type(units, unit)
        wanted = units.select(F.col(unit).cast(unit_type).alias("_unit"), F.col(vector).alias("_vector"))
        blocks = 1
        if wanted.limit(max_units + 1).count() > max_units:
            wanted = keep(wanted, "index-units")
            blocks = -(-wanted.count() // max_units)
        out = None
        for block in range(blocks):
            part = wanted.filter(F.pmod(F.xxhash64("_unit"), F.lit(blocks)) == block) if blocks > 1 else wanted
            found = self._search_block(part, unit_type, k)
            out = found if out is None else out.unionAll(found)
        return out.select(F.col("_unit").alias(unit), F.col("_key").alias(self.key), "score", "rank")

    def _search_block(self, units: DataFrame, unit_type: str, k: int) -> DataFrame:
        spark, key_type = units.sparkSession, _id_type(self.rows, self.key)
        table = units.toArrow()  # about ``max_units`` rows
        ids, matrix = _vectors(table.column(0), table.column(1))
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order]
        if not len(ids) or not len(self.counts):
            return spark.createDataFrame([], f"{_found(unit_type, key_type)}, rank int")
        bounds = self.bounds(_unit_rows(matrix))
        by_bound = np.argsort(-bounds, axis=1, kind="stable")
        held = np.cumsum(self.counts[by_bound], axis=1) - self.counts[by_bound]  # rows before each, in that order
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, by_bound, held < k, axis=1)
        first &= np.isfinite(bounds)
        found = keep(_first_k(self._scored(ids, matrix, first, k, unit_type, key_type), k), "index-first")

        last = {r["_unit"]: r["last"] for r in found.groupBy("_unit").agg(F.count("*").alias("n"), F.min("score").alias("last")).collect() if r["n"] >= k}
        floor = np.array([last.get(i, -np.inf) for i in ids.tolist()]) - SLACK
        second = (bounds >= floor[:, None]) & ~first & np.isfinite(bounds)
        if not second.any():
            return found
        more = self._scored(ids, matrix, second, k, unit_type, key_type)
        return _first_k(found.drop("rank").unionAll(more), k)

    def _scored(self, ids: np.ndarray, matrix: np.ndarray, visits: np.ndarray, k: int, unit_type: str, key_type: str) -> DataFrame:
        """Each task's k best rows per unit, of the clusters that ``visits`` (unit, cluster) names."""
        rows = self.clusters(visits.any(0)).select(F.col(self.key).cast(key_type).alias("_key"), self.vector, "cluster")
        shared = rows.sparkSession.sparkContext.broadcast((ids, matrix, visits))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit_ids, units, open_ = shared.value
            heads = _Heads(unit_ids, units, k)
            for batch in batches:
                clusters = batch.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(clusters):  # files hold one cluster each, batches mostly too
                    part = batch.filter(pa.array(clusters == c))
                    heads.add(*_vectors(part.column(0), part.column(1)), np.flatnonzero(open_[:, c]))
            columns = heads.columns()
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(_found_batch(columns, unit_type, key_type), ["_unit", "_key", "score"])

        return rows.mapInArrow(score, _found(unit_type, key_type))


def _first_k(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["_unit"], [F.desc("score"), F.col("_key")], k, ["_key"])


def _sample(rows: DataFrame, key: str) -> DataFrame:
    """The rows of the ``SAMPLE`` smallest hashes of keys, more where keys repeat.

    Only hashes are ordered: an ordered head of the vectors would send that many of every task to the driver.
    """
    hashed = F.xxhash64(key)
    last = rows.select(hashed.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    return rows.filter(hashed <= F.lit(last))


def write_vector_index(df: DataFrame, key: str, vector: str, path: str, clusters: int | None = None) -> VectorIndex:
    """Cluster the vectors of ``df`` and write them below ``path``; rows without a usable vector are left out.

    About as many clusters as the square root of the rows. Vectors have one length.
    """
    spark = df.sparkSession
    # filtered as read back, so that vectors are made once
    built = keep(scaled_vectors(df, key, vector), "index-rows").filter("norm > 0")
    n = built.count()
    clusters = min(MAX_CLUSTERS, clusters or max(1, round(n**0.5)))
    few = _sample(built, key).select(vector).limit(SAMPLE).collect()
    centres = _fit_centres(np.array([r[0] for r in few]), clusters) if few else np.empty((0, 0))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                far = _squared(flat, shared.value)
                near = far.argmin(1)
                exact = np.sqrt(((flat - shared.value[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near, pa.int32()), pa.array(exact)], [*batch.schema.names, "cluster", "far"]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in built.schema.fields)
    placed = short_batches(built).mapInArrow(place, f"{fields}, cluster int, far double")
    # a cluster's rows come together in a file; one that is too large for a task is split over several
    placed.hint("rebalance", "cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/rows")
    written = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    sizes = written.groupBy("cluster").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    names = spark.createDataFrame([(key, vector)], "key string, vector string")  # one row
    bounds = middle.join(sizes, "cluster", "left").select("cluster", "centre", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("n", F.lit(0)).alias("n"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")  # a row per cluster
    names.write.mode("overwrite").parquet(f"{path}/names")
    return read_vector_index(spark, path)


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    key, vector = spark.read.parquet(f"{path}/names").first()
    bounds = sorted(spark.read.schema("cluster int, centre array<double>, radius double, n long").parquet(f"{path}/bounds").collect())
    centres = np.array([b["centre"] for b in bounds])
    radii, counts = np.array([b["radius"] for b in bounds], float), np.array([b["n"] for b in bounds], np.int64)
    if not counts.sum():
        rows = spark.createDataFrame([], f"`{key}` long, `{vector}` array<double>, cluster int")
        return VectorIndex(rows, key, vector, np.empty((0, 0)), np.empty(0), np.empty(0, np.int64))
    return VectorIndex(spark.read.parquet(f"{path}/rows"), key, vector, centres, radii, counts)
