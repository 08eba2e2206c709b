"""De-duplication, label merging and counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions.text import empty, missing
from recordloom.operators import dedup as D
from recordloom.operators import quality as Q
from recordloom.operators.bitmaps import BatchCounts
from recordloom.operators.scale import number_rows, skew_join
from recordloom.plans.registry import query, table
from recordloom.session import work_dir


@query(
    "first_wins",
    """SELECT text, arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text""",
)
def first_wins(spark, sf):
    docs = table(spark, sf, "documents").select("text", "doc_id", "source")
    return D.first_wins(docs, ["text"], ["doc_id"])


def _titled_pages(spark, sf):
    """Titles per site: some with a time prefix, some cut off."""
    page = F.col("url")
    return table(spark, sf, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("site"),
        "page_id",
        F.concat(
            F.when(page.contains("/en/"), "9:00am - 5:00pm ").otherwise(""),
            F.regexp_extract("html", r"<h1>(.*?)</h1>", 1),
            F.when(page.rlike("(html|/)$"), "...").otherwise(""),
        ).alias("title"),
    )


TITLED = r"""
WITH t AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS site, page_id,
  regexp_extract(html, '<h1>(.*?)</h1>', 1) || CASE WHEN regexp_matches(url, '(html|/)$') THEN '...' ELSE '' END AS title FROM pages),
s AS (SELECT *, title LIKE '%...' AS cut FROM t),
f AS (SELECT *, max(CASE WHEN NOT cut THEN page_id END) OVER (PARTITION BY site) AS last_full,
        max(page_id) OVER (PARTITION BY site) AS last_id FROM s)
"""


@query(
    "full_titles",
    TITLED
    + """SELECT site, coalesce(arg_max(title, page_id) FILTER (NOT cut), arg_min(title, page_id)) AS title FROM f GROUP BY site""",
)
def full_titles(spark, sf):
    return D.prefer_full_titles(_titled_pages(spark, sf), "site", "title", ["page_id"])


@query(
    "full_titles_compat",
    TITLED
    + """SELECT site, coalesce(arg_min(title, page_id) FILTER (cut AND page_id > coalesce(last_full, -1)),
                               arg_max(title, page_id) FILTER (NOT cut)) AS title FROM f GROUP BY site""",
)
def full_titles_compat(spark, sf):
    return D.prefer_full_titles(_titled_pages(spark, sf), "site", "title", ["page_id"], mode="compat")


@query(
    "merge_labels",
    """WITH d AS (SELECT l_partkey, l_returnflag, min(l_shipdate) AS pos FROM lineitem GROUP BY 1, 2)
       SELECT l_partkey, string_agg(l_returnflag, ', ' ORDER BY pos, l_returnflag) AS session_types, count(*) > 1 AS shared
       FROM d GROUP BY 1""",
)
def merge_labels(spark, sf):
    merged = D.merge_labels(table(spark, sf, "lineitem"), "l_partkey", "l_returnflag", ["l_shipdate"])
    return merged.select("l_partkey", F.array_join("labels", ", ").alias("session_types"), "shared")


@query(
    "shared_labels",
    """SELECT l_orderkey, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1
       HAVING count(DISTINCT l_linestatus) > 1""",
)
def shared_labels(spark, sf):
    merged = D.merge_labels(table(spark, sf, "lineitem"), "l_orderkey", "l_linestatus", ["l_linestatus"])
    return merged.filter("shared").select("l_orderkey", F.size("labels").cast("long").alias("n"))


@query(
    "invert_membership",
    """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority DESC) AS key_themes
       FROM orders GROUP BY 1""",
)
def invert_membership(spark, sf):
    # one row per sighting of an id under a theme; an id seen often collapses before the shuffle
    members = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("theme"),
        (-F.substring("o_orderpriority", 1, 1).cast("int")).alias("theme_no"),
        F.array("o_custkey").alias("ids"),
    )
    out = D.invert_membership(members, "theme", "ids", "theme_no", "o_custkey", "key_themes")
    return out.select("o_custkey", F.array_join("key_themes", " | ").alias("key_themes"))


@query("count_by", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by(spark, sf):
    return Q.count_by(table(spark, sf, "events"), "event_type")


@query(
    "coverage",
    """SELECT count(*) AS total, count(*) FILTER (text <> '') AS with_text, count(quality) AS labelled,
         count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality IS NULL) AS remaining
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def coverage(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    joined = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return Q.coverage(
        joined,
        {
            "with_text": ~missing(F.col("text")),
            "labelled": F.col("quality").isNotNull(),
            "good": F.col("quality") == 1,
            "remaining": F.col("quality").isNull(),
        },
    )


@query(
    "coverage_by_list",
    """WITH t AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
       SELECT count(*) AS total, count(o_custkey) AS with_themes FROM customer LEFT JOIN t ON c_custkey = o_custkey""",
)
def coverage_by_list(spark, sf):
    key = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(-1 - F.col("o_custkey"))
    orders = table(spark, sf, "orders").withColumn("o_custkey", key)
    lists = D.distinct_lists(orders, "o_custkey", "o_orderpriority", ["o_orderpriority"], "themes")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return Q.coverage(rows.join(lists, "o_custkey", "left"), {"with_themes": ~empty(F.col("themes"))})


@query(
    "expected_counts",
    """WITH e AS (SELECT event_type, floor(avg(c)) + 1 AS expected FROM (
           SELECT event_type, user_id, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1),
       a AS (SELECT event_type, count(*) FILTER (value > 100) AS actual FROM events GROUP BY 1)
       SELECT event_type, CAST(expected AS BIGINT) AS expected, actual, actual < expected AS short FROM e JOIN a USING (event_type)""",
)
def expected_counts(spark, sf):
    events = table(spark, sf, "events")
    per_user = events.groupBy("event_type", "user_id").agg(F.count("*").alias("c"))
    expected = per_user.groupBy("event_type").agg((F.floor(F.avg("c")) + 1).alias("expected"))
    # the others count for a type that nothing is expected of
    kind = F.when(F.col("value") > 100, F.col("event_type")).otherwise(F.concat("event_type", F.lit(" (low)")))
    return Q.reconcile_counts(events.withColumn("event_type", kind), "event_type", expected)


@query(
    "people_per_record",
    """WITH p AS (SELECT l_orderkey, p_brand, min(l_linenumber) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
       SELECT l_orderkey, string_agg(p_brand, '; ' ORDER BY pos, p_brand) AS people FROM p GROUP BY 1""",
)
def people_per_record(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    named = skew_join(lines, part, ["l_partkey"], ["l_orderkey", "l_linenumber"], "inner")
    out = D.distinct_lists(named, "l_orderkey", "p_brand", ["l_linenumber"], "people")
    return out.select("l_orderkey", F.array_join("people", "; ").alias("people"))


@query(
    "people_parts",
    """WITH p AS (SELECT l_suppkey, l_orderkey, min(l_orderkey) AS pos FROM lineitem GROUP BY 1, 2)
       SELECT l_suppkey, CAST(floor(pos / 1000.0) AS BIGINT) AS part, string_agg(CAST(l_orderkey AS VARCHAR), ' ' ORDER BY pos) AS people
       FROM p GROUP BY 1, 2""",
)
def people_parts(spark, sf):
    lines = table(spark, sf, "lineitem")
    named = lines.select("l_suppkey", F.col("l_orderkey").alias("at"), F.col("l_orderkey").cast("string").alias("person"))
    out = D.distinct_list_parts(named, "l_suppkey", "person", "at", "people", part_size=1000)
    return out.select("l_suppkey", "part", F.array_join("people", " ").alias("people"))


@query(
    "text_per_unit",
    """SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS unit_text FROM conversations GROUP BY 1""",
)
def text_per_unit(spark, sf):
    return D.text_per_unit(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query(
    "text_parts",
    """SELECT role, CAST(n // 100 AS BIGINT) AS part, string_agg('[' || turn || '] ' || text, chr(10) ORDER BY n) AS unit_text
       FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n FROM conversations) GROUP BY 1, 2""",
)
def text_parts(spark, sf):
    """All texts of every role in order, a hundred to a part."""
    rows = table(spark, sf, "conversations").withColumn("at", F.struct("conv_id", "turn"))
    rows = number_rows(rows, "at", "n", group=["role"]).withColumn("turn", F.col("turn").cast("string"))
    return D.text_parts(rows, "role", "n", "turn", "text", part_size=100)


@query(
    "completeness",
    """WITH w AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'),
            d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F')
       SELECT count(w.k) AS wanted, count(d.k) AS done, count(*) FILTER (d.k IS NULL) AS open,
         count(*) FILTER (w.k IS NULL) AS extra, count(*) FILTER (d.k IS NULL OR w.k IS NULL) = 0 AS complete
       FROM w FULL OUTER JOIN d ON w.k = d.k""",
)
def completeness(spark, sf):
    wanted = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    done = table(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"))
    return Q.completeness(wanted, done, "id")


@query(
    "coverage_merged",
    """SELECT count(*) AS total, count(*) FILTER (o_totalprice > 150000) AS dear, count(*) FILTER (o_orderstatus = 'F') AS closed
       FROM orders""",
)
def coverage_merged(spark, sf):
    """A batch per priority, all orders again as the last batch: counted once, from bitmaps."""
    orders = table(spark, sf, "orders")
    checks = {"dear": F.col("o_totalprice") > 150000, "closed": F.col("o_orderstatus") == "F"}
    counts = BatchCounts(spark, work_dir(spark, "bitmaps"))
    urgent = F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")
    for name, batch in (("a", orders.filter(urgent)), ("b", orders.filter(~urgent)), ("c", orders)):
        counts.add(name, batch, "o_orderkey", checks)
    return counts.coverage(*checks)


@query(
    "completeness_merged",
    """WITH w AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'),
            d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F')
       SELECT count(w.k) AS wanted, count(d.k) AS done, count(*) FILTER (d.k IS NULL) AS open,
         count(*) FILTER (w.k IS NULL) AS extra, count(*) FILTER (d.k IS NULL OR w.k IS NULL) = 0 AS complete
       FROM w FULL OUTER JOIN d ON w.k = d.k""",
)
def completeness_merged(spark, sf):
    """Orders and lines arrive as batches of their own; nothing is joined."""
    counts = BatchCounts(spark, work_dir(spark, "bitmaps"))
    counts.add("orders", table(spark, sf, "orders"), "o_orderkey", {"wanted": F.col("o_orderstatus") != "P"})
    counts.add("lines", table(spark, sf, "lineitem"), "l_orderkey", {"done": F.col("l_linestatus") == "F"})
    return counts.completeness("wanted", "done")
