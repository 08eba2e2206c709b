"""Filters, field rules, batching and report heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import quality as Q
from recordloom.operators.text_index import write_text_index
from recordloom.plans.registry import query, table
from recordloom.session import work_dir

DAY = "yyyy-MM-dd"


@query(
    "only_missing",
    """SELECT c_custkey, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '' END AS company_url FROM customer
       WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')""",
)
def only_missing(spark, sf):
    segment = F.col("c_mktsegment")
    rows = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", F.when(segment == "BUILDING", "").when(segment != "FURNITURE", segment).alias("company_url")
    )
    return Q.only_missing(rows, "company_url")


@query(
    "any_missing",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderpriority END AS location FROM orders
       WHERE o_orderstatus = 'O' OR o_orderpriority = '1-URGENT'""",
)
def any_missing(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"),
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "O", F.date_format("o_orderdate", DAY)).alias("date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderpriority")).alias("location"),
    )
    return Q.any_missing(rows, "key", ["date", "location"]).drop("key")


@query(
    "keep_categories",
    """SELECT p_partkey, p_name, CASE WHEN lower(p_name) LIKE '%widget%' THEN 'widget' ELSE 'old' END AS category FROM part
       WHERE lower(p_name) LIKE '%widget%' OR lower(p_name) LIKE '%old%'""",
)
def keep_categories(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    return Q.keep_categories(rows, "p_name", ["widget", "old"])


@query(
    "search",
    """SELECT p_partkey, p_name, p_brand, p_type FROM part
       WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')""",
)
def search(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return Q.search(rows, "RING", ["p_name", "p_brand", "p_type"])


@query(
    "search_text",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'and the ') OR contains(lower(lang), 'and the ')",
)
def search_text(spark, sf):
    return Q.search(table(spark, sf, "documents"), "AND the ", ["text", "lang"]).select("doc_id")


@query(
    "search_indexed",
    """SELECT p_partkey, p_name, p_brand, p_type FROM part
       WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')""",
)
def search_indexed(spark, sf):
    """The same through trigram postings, which are written first and would be searched many times."""
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    index = write_text_index(rows, "p_partkey", ["p_name", "p_brand", "p_type"], work_dir(spark, "postings"))
    return index.search(rows, "RING")


@query(
    "paper_display",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'Untitled' ELSE text END AS title,
         CASE WHEN lang = 'de' THEN 'Unknown Authors' ELSE lang END AS authors, source AS venue, '#' AS link,
         CASE WHEN coalesce(quality, 0) * n_chars = 0 THEN 'N/A' ELSE printf('%.4f', quality * n_chars / 8.0) END AS affinity_score
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def paper_display(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    papers = docs.select(
        "doc_id",
        F.when(F.col("lang") != "en", F.col("text")).alias("title"),
        F.when(F.col("lang") == "de", "").otherwise(F.col("lang")).alias("authors"),
        F.col("source").alias("venue"),
        F.lit(None).cast("string").alias("link"),
        (F.col("quality") * F.col("n_chars") / 8.0).alias("affinity_score"),
    )
    return Q.paper_display(papers)


def _upload_rows(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(status != "P", F.date_format("o_orderdate", DAY)).alias("date"),
        F.lit("09:00").alias("start"),
        F.when(status == "F", "10:30").otherwise("11:00").alias("end"),
    )


UPLOAD = """
WITH u AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS title,
  CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, '09:00' AS start,
  CASE WHEN o_orderstatus = 'F' THEN '10:30' ELSE '11:00' END AS "end" FROM orders)
"""


@query("required_fields", UPLOAD + "SELECT * FROM u WHERE title <> '' AND date IS NOT NULL")
def required_fields(spark, sf):
    kept, _ = Q.split_required(_upload_rows(spark, sf))
    return kept


@query(
    "required_fields_rejected",
    UPLOAD
    + """SELECT o_orderkey, concat_ws(',', CASE WHEN title = '' THEN 'title' END, CASE WHEN date IS NULL THEN 'date' END) AS lacking
         FROM u WHERE title = '' OR date IS NULL""",
)
def required_fields_rejected(spark, sf):
    _, rejected = Q.split_required(_upload_rows(spark, sf))
    return rejected.select("o_orderkey", F.array_join("lacking", ",").alias("lacking"))


@query(
    "resolve_aliases",
    """SELECT CASE WHEN o_orderstatus = 'O' THEN o_orderkey ELSE -o_orderkey END AS session_id, o_orderstatus AS room,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 'Panel' ELSE o_orderpriority END AS session_type FROM orders""",
)
def resolve_aliases(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")).alias("session_id"),
        (-F.col("o_orderkey")).alias("code"),
        F.col("o_orderstatus").alias("location"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "").otherwise(F.col("o_orderpriority")).alias("session_type"),
        F.lit("Panel").alias("sessionType"),
    )
    return Q.resolve_aliases(rows)


@query(
    "validate_fields",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'date' END,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'start' END, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'format' END,
         CASE WHEN o_orderstatus = 'O' THEN 'recording' END) AS errors FROM orders""",
)
def validate_fields(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "P", F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", DAY)).alias("date"),
        F.when(priority == "1-URGENT", "25:00").otherwise("09:00").alias("start"),
        F.lit("23:59").alias("end"),
        F.when(priority == "4-NOT SPECIFIED", "Hybrid").when(priority == "5-LOW", "").otherwise("Both").alias("format"),
        F.when(status == "O", "maybe").when(status == "P", "No").alias("recording"),
    )
    out = Q.validate(rows, Q.flat_session_rules())
    return out.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query(
    "validate_envelope",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'sessionFormat' ELSE '' END AS errors,
         o_orderstatus = 'F' AS "hasRecording" FROM orders""",
)
def validate_envelope(spark, sf):
    priority = F.col("o_orderpriority")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(priority == "5-LOW", "In-Person").when(priority != "2-HIGH", "IN_PERSON").alias("sessionFormat"),
        F.when(F.col("o_orderstatus") == "F", True).alias("hasRecording"),
    )
    out = Q.default_recording(Q.validate(rows, Q.envelope_session_rules()))
    return out.select("o_orderkey", F.array_join("errors", ",").alias("errors"), "hasRecording")


@query(
    "upload_batches",
    "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS batch FROM orders",
)
def upload_batches(spark, sf):
    return Q.upload_batches(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "project_columns",
    """SELECT o_orderkey AS session_id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS date,
         'IN_PERSON' AS "sessionFormat", false AS "hasRecording" FROM orders""",
)
def project_columns(spark, sf):
    rows = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", DAY))
    names = {"session_id": "o_orderkey", "title": "o_orderpriority", "date": "day"}
    return Q.project(rows, names, {"sessionFormat": "IN_PERSON", "hasRecording": False})


@query(
    "report_head",
    "SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS total FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20",
)
def report_head(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return Q.report_head(rows, [F.desc("s_acctbal"), "s_suppkey"], 20).drop("s_acctbal")


def _fetched(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("session_id"),
        F.col("text").alias("title"),
        F.col("source").alias("url"),
        F.when(F.col("quality").isNull(), "Failed to extract").alias("error"),
        "lang",
    )


@query(
    "error_split_ok",
    "SELECT doc_id AS session_id, text AS title, source AS url, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def error_split_ok(spark, sf):
    return Q.split_errors(_fetched(spark, sf), ["session_id", "title", "url"])[0]


@query(
    "error_split_failed",
    """SELECT doc_id AS session_id, text AS title, source AS url, 'Failed to extract' AS error FROM documents
       WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def error_split_failed(spark, sf):
    return Q.split_errors(_fetched(spark, sf), ["session_id", "title", "url"])[1]


@query(
    "agenda_order",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS "startTime", o_orderkey AS title
       FROM orders ORDER BY 1, 2, 3""",
)
def agenda_order(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", DAY).alias("date"),
        F.col("o_orderpriority").alias("startTime"),
        F.col("o_orderkey").alias("title"),
    )
    return Q.agenda(rows)
