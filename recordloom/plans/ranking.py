"""Vector search, re-rank, annotation and the whole matching cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import lists as L
from recordloom.functions import scores as S
from recordloom.operators import match as M
from recordloom.operators import tournament as C
from recordloom.operators.remembered import Remembered
from recordloom.operators.vector_index import read_vector_index, write_vector_index
from recordloom.plans.registry import query, table
from recordloom.session import work_dir


def _units(spark, sf):
    """One unit per label: the mean of its vectors."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    means = cells.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    cell = F.array_sort(F.collect_list(F.struct("d", "x")))
    return means.groupBy("label").agg(F.transform(cell, lambda c: c["x"]).alias("embedding"))


UNITS = """
WITH c AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
m AS (SELECT label, d, avg(CAST(x AS DOUBLE)) AS x FROM c GROUP BY 1, 2),
u AS (SELECT label, list(x ORDER BY d) AS v FROM m GROUP BY 1),
s AS (SELECT u.label, e.vec_id, round(list_cosine_similarity(u.v, CAST(e.embedding AS DOUBLE[])), 6) AS score FROM u, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
"""


@query("vector_search", UNITS + "SELECT CAST(label AS BIGINT) AS label, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 150")
def vector_search(spark, sf):
    return M.search(table(spark, sf, "embeddings"), _units(spark, sf), "vec_id", "label", "embedding")


@query(
    "best_unit",
    UNITS
    + """SELECT vec_id, CAST(label AS BIGINT) AS label, score FROM (
           SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS b FROM s) WHERE b = 1""",
)
def best_unit(spark, sf):
    return M.best_unit(table(spark, sf, "embeddings"), _units(spark, sf), "vec_id", "label", "embedding")


@query("rank_per_unit", UNITS + "SELECT CAST(label AS BIGINT) AS label, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50")
def rank_per_unit(spark, sf):
    hits = M.search(table(spark, sf, "embeddings"), _units(spark, sf), "vec_id", "label", "embedding").drop("rank")
    return M.rank_per_unit(hits, "label", "score", "vec_id", M.FINAL_K)


@query("unit_counts", UNITS + "SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM r WHERE rank <= 50 GROUP BY 1")
def unit_counts(spark, sf):
    return M.unit_counts(rank_per_unit(spark, sf), "label")


@query(
    "vector_index",
    """SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * x for x in embedding])), 6) AS norm,
         round(embedding[1] / sqrt(list_sum([CAST(x AS DOUBLE) * x for x in embedding])), 6) AS first_value,
         CAST(1 AS DOUBLE) AS length FROM embeddings""",
)
def vector_index(spark, sf):
    built = M.build_index(table(spark, sf, "embeddings"), "vec_id", "embedding")
    index = M.write_index(built, work_dir(spark, "index"))
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return index.select(
        "vec_id",
        F.round("norm", 6).alias("norm"),
        F.round(F.col("embedding")[0], 6).alias("first_value"),
        F.round(length, 6).alias("length"),
    )


@query(
    "composite_score",
    """SELECT doc_id, round((0.45 * r + 0.35 * t + 0.10 * n + 0.10 * a) * (0.5 + 0.5 * c), 6) AS final_score FROM (
         SELECT doc_id, quality AS r, 1.0 - toxic AS t, (n_chars % 100) / 100.0 AS n, (n_chars % 7) / 7.0 AS a, (doc_id % 10) / 10.0 AS c
         FROM documents JOIN labels USING (doc_id))""",
)
def composite_score(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    parts = {
        "rel": F.col("quality").cast("double"),
        "tech_overlap": 1.0 - F.col("toxic"),
        "novelty": (F.col("n_chars") % 100) / 100.0,
        "actionability": (F.col("n_chars") % 7) / 7.0,
    }
    score = S.composite(parts, (F.col("doc_id") % 10) / 10.0)
    return docs.select("doc_id", F.round(score, 6).alias("final_score"))


@query(
    "record_text",
    """SELECT doc_id, 'Title: ' || source || ' | Topic: ' || lang || ' | Industry:  | Abstract: ' ||
         CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END || ' | Key Takeaways: ' ||
         CASE WHEN lang = 'en' THEN CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END ELSE 'one | ' || source END ||
         ' | NVIDIA Technology:  | Speakers: Ann (' || source || ') | Technical Level: ' || lang || ' | Audience: all' AS record_text
       FROM documents""",
)
def record_text(spark, sf):
    empty = F.lit(None).cast("string")
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("title"),
        F.col("lang").alias("topic"),
        empty.alias("industry"),
        F.col("text").alias("abstract"),
        F.when(F.col("lang") == "en", F.col("text")).otherwise(F.to_json(F.array(F.lit("one"), F.col("source")))).alias("key_takeaways"),
        empty.alias("nvidia_technology"),
        F.to_json(F.array(F.struct(F.lit("Ann").alias("name"), F.col("source").alias("company")))).alias("speakers"),
        F.col("lang").alias("technical_level"),
        F.lit("all").alias("intended_audience"),
    )
    return M.record_text(rows).select("doc_id", "record_text")


@query(
    "people_text",
    """SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN '' ELSE c_name || ' (' || c_mktsegment || '); Bob ()' END AS speakers,
         CASE WHEN c_nationkey < 5 THEN 'plain ' || c_name WHEN c_nationkey < 10 THEN '' ELSE c_name || ' | ' || c_mktsegment END AS takeaways
       FROM customer""",
)
def people_text(spark, sf):
    nation = F.col("c_nationkey")
    people = F.array(
        F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("company")),
        F.struct(F.lit("Bob").alias("name"), F.lit(None).cast("string").alias("company")),
    )
    speakers = F.when(nation < 5, F.lit("not json")).otherwise(F.to_json(people))
    takeaways = (
        F.when(nation < 5, F.concat(F.lit("plain "), "c_name")).when(nation >= 10, F.to_json(F.array("c_name", "c_mktsegment")))
    )
    return table(spark, sf, "customer").select(
        "c_custkey", L.people_text(speakers).alias("speakers"), L.takeaways_text(takeaways).alias("takeaways")
    )


WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
MATCH = (
    "WITH rw AS (SELECT doc_id, unnest(" + WORDS.format("text") + ") AS w FROM documents),\n"
    "uw AS (SELECT item_id, unnest(" + WORDS.format("text") + """) AS w FROM benchmark),
rb AS (SELECT doc_id, CAST('0x' || md5(w)[1:8] AS BIGINT) % 256 AS b, count(*) AS n FROM rw GROUP BY 1, 2),
ub AS (SELECT item_id, CAST('0x' || md5(w)[1:8] AS BIGINT) % 256 AS b, count(*) AS n FROM uw GROUP BY 1, 2),
rn AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM rb GROUP BY 1),
un AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM ub GROUP BY 1),
dots AS (SELECT item_id, doc_id, sum(rb.n * ub.n) AS dot FROM rb JOIN ub USING (b) GROUP BY 1, 2),
sims AS (SELECT un.item_id, documents.doc_id, round(coalesce(dot / (rn.norm * un.norm), 0), 6) AS score
         FROM un CROSS JOIN documents LEFT JOIN rn USING (doc_id) LEFT JOIN dots ON dots.item_id = un.item_id AND dots.doc_id = documents.doc_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sims) WHERE rank <= 150),
rd AS (SELECT DISTINCT doc_id, w FROM rw), ud AS (SELECT DISTINCT item_id, w FROM uw),
us AS (SELECT item_id, count(*) AS n FROM ud GROUP BY 1),
common AS (SELECT item_id, doc_id, count(*) AS n, string_agg(w, ', ' ORDER BY w) AS words
           FROM ud JOIN rd USING (w) JOIN hits USING (item_id, doc_id) GROUP BY 1, 2),
scored AS (SELECT hits.item_id, hits.doc_id, score, round(coalesce(common.n, 0) / us.n, 6) AS rerank_score, coalesce(words, '') AS words
           FROM hits JOIN us USING (item_id) LEFT JOIN common ON common.item_id = hits.item_id AND common.doc_id = hits.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, score DESC, doc_id) AS rank FROM scored)
"""
)


def _texts(spark, sf):
    records = table(spark, sf, "documents", spread="doc_id").select("doc_id", F.col("text").alias("record_text"))
    units = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("unit_text"))
    return records, units


@query(
    "match_cascade",
    MATCH
    + """SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, score, rerank_score, 'Shared terms: ' || words AS recommendation_reason
         FROM ranked WHERE rank <= 50""",
)
def match_cascade(spark, sf):
    records, units = _texts(spark, sf)
    return M.cascade(records, units, "doc_id", "item_id", "record_text", "unit_text")


@query(
    "match_cascade_indexed",
    MATCH
    + """SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, score, rerank_score, 'Shared terms: ' || words AS recommendation_reason
         FROM ranked WHERE rank <= 50""",
)
def match_cascade_indexed(spark, sf):
    """The cascade over a stored index, which is written first and would be searched many times."""
    records, units = _texts(spark, sf)
    index = write_vector_index(M.vectorise(records, "record_text"), "doc_id", "vector", work_dir(spark, "stored-index"))
    return M.cascade(records, units, "doc_id", "item_id", "record_text", "unit_text", index=index)


@query("indexed_search", UNITS + "SELECT CAST(label AS BIGINT) AS label, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def indexed_search(spark, sf):
    path = work_dir(spark, "stored-index")
    write_vector_index(table(spark, sf, "embeddings"), "vec_id", "embedding", path)
    return read_vector_index(spark, path).search(_units(spark, sf), "label", "embedding", 20)


@query("text_search", MATCH + "SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM hits")
def text_search(spark, sf):
    records, units = _texts(spark, sf)
    return M.search(
        M.vectorise(records, "record_text"), M.vectorise(units, "unit_text"), "doc_id", "item_id", "vector"
    )


def _candidates(spark, sf):
    records, units = _texts(spark, sf)
    hits = M.keep(text_search(spark, sf), "hits")
    return M.with_contents(hits, records, units, "doc_id", "item_id", "record_text", "unit_text")


@query("rerank", MATCH + "SELECT item_id, doc_id, score, rerank_score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 50")
def rerank(spark, sf):
    return M.rerank(_candidates(spark, sf), "doc_id", "item_id").drop("_record", "_unit")


@query("annotate", MATCH + "SELECT item_id, doc_id, 'Shared terms: ' || words AS recommendation_reason FROM scored")
def annotate(spark, sf):
    return M.annotate(_candidates(spark, sf)).select("item_id", "doc_id", "recommendation_reason")


@query("annotate_remembered", MATCH + "SELECT item_id, doc_id, 'Shared terms: ' || words AS recommendation_reason FROM scored")
def annotate_remembered(spark, sf):
    """The same with a stored table of texts, by a second run that has nothing left to ask."""
    pairs, notes = _candidates(spark, sf), Remembered(spark, work_dir(spark, "remembered"))
    notes.annotate(pairs, "shared terms")
    again = notes.annotate(pairs, "shared terms", generator=lambda record, unit: F.raise_error(F.lit("asked again")).cast("string"))
    return again.select("item_id", "doc_id", "recommendation_reason")


@query(
    "top_k_by_comparison",
    MATCH
    + """SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (
           SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, doc_id) AS rank FROM scored) WHERE rank <= 50""",
)
def top_k_by_comparison(spark, sf):
    """The re-rank without scores: which of two records holds more of the unit's words."""
    return C.top_k_by_comparison(_candidates(spark, sf), "doc_id", "item_id").drop("compared")
