"""Diff, patch, merge and lookup over the order tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from recordloom.functions.urls import KNOWN_COMPANIES, company_url
from recordloom.operators import digests as D
from recordloom.operators import reconcile as R
from recordloom.operators.dedup import distinct_lists
from recordloom.operators.scale import last_per_key, skew_join
from recordloom.operators.stored import StoredTable
from recordloom.plans.registry import query, table
from recordloom.session import work_dir

DAY = "yyyy-MM-dd"


def snapshots(spark, sf):
    """Two states of one catalogue: before, without the pending orders; now, without the low ones."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"),
        F.concat(F.lit("/orders/"), "o_orderkey").alias("url"),
        "o_orderstatus",
        "o_orderpriority",
    )
    old = orders.filter("o_orderstatus <> 'P'").drop("o_orderstatus", "o_orderpriority")
    new = orders.filter("o_orderpriority <> '5-LOW'").withColumn(
        "title", F.when(F.col("o_orderpriority") == "2-HIGH", F.upper(F.concat("title", F.lit(" (moved)")))).otherwise(F.col("title"))
    )
    return old, new.drop("o_orderstatus", "o_orderpriority")


SNAPSHOTS = """
WITH base AS (
  SELECT o_orderkey AS session_id, o_orderpriority || ' ' || o_orderstatus AS title,
         '/orders/' || o_orderkey AS url, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
old AS (SELECT session_id, title, url FROM base WHERE st <> 'P'),
new AS (SELECT session_id, CASE WHEN pr = '2-HIGH' THEN upper(title || ' (moved)') ELSE title END AS title, url
        FROM base WHERE pr <> '5-LOW'),
diff AS (
  SELECT coalesce(o.session_id, n.session_id) AS session_id,
         CASE WHEN o.session_id IS NULL THEN 'added' WHEN n.session_id IS NULL THEN 'removed' ELSE 'common' END AS change,
         o.title AS old_title, o.url AS old_url, n.title AS new_title, n.url AS new_url
  FROM old o FULL OUTER JOIN new n ON o.session_id = n.session_id)
"""


@query("snapshot_diff", SNAPSHOTS + "SELECT * FROM diff")
def snapshot_diff(spark, sf):
    old, new = snapshots(spark, sf)
    return R.snapshot_diff(old, new, "session_id")


@query(
    "snapshot_diff_content",
    SNAPSHOTS
    + """SELECT CASE WHEN change = 'common' AND old_title <> new_title THEN 'changed' ELSE change END AS change,
         count(*) AS n FROM diff GROUP BY 1""",
)
def snapshot_diff_content(spark, sf):
    old, new = snapshots(spark, sf)
    diff = R.snapshot_diff(old, new, "session_id", compare=["title", "url"])
    return diff.groupBy("change").agg(F.count("*").alias("n"))


@query(
    "snapshot_changed_rows",
    SNAPSHOTS
    + """SELECT * REPLACE (CASE WHEN change = 'common' THEN 'changed' ELSE change END AS change) FROM diff
         WHERE change <> 'common' OR old_title <> new_title OR old_url <> new_url""",
)
def snapshot_changed_rows(spark, sf):
    """The same by digests of key buckets; only rows of buckets that differ are joined."""
    old, new = snapshots(spark, sf)
    return D.changed_rows(old, new, "session_id", ["title", "url"])


@query(
    "snapshot_change_counts",
    SNAPSHOTS
    + """SELECT CASE WHEN change = 'common' AND old_title <> new_title THEN 'changed' ELSE change END AS change,
         CAST(count(*) AS BIGINT) AS n FROM diff GROUP BY 1""",
)
def snapshot_change_counts(spark, sf):
    """Counts of all rows from what changed and the digests that were stored with the old snapshot."""
    old, new = snapshots(spark, sf)
    columns, path = ["title", "url"], work_dir(spark, "digests")
    D.snapshot_digests(old, "session_id", columns).write.parquet(path)
    stored = spark.read.parquet(path)
    return D.change_counts(D.changed_rows(old, new, "session_id", columns, old_digests=stored), stored)


@query(
    "snapshot_diff_batches",
    """WITH o AS (SELECT l_partkey AS k, arg_min(l_shipmode, pos) AS t FROM (
           SELECT l_partkey, l_orderkey * 100 + l_linenumber AS pos, l_returnflag || l_linestatus AS l_shipmode FROM lineitem WHERE l_quantity < 25
           QUALIFY row_number() OVER (PARTITION BY l_partkey, pos ORDER BY l_shipmode) = 1) GROUP BY 1),
       n AS (SELECT l_partkey AS k, arg_min(l_shipmode, pos) AS t FROM (
           SELECT l_partkey, l_orderkey * 100 + l_linenumber AS pos, l_returnflag || l_linestatus AS l_shipmode FROM lineitem WHERE l_discount > 0.04
           QUALIFY row_number() OVER (PARTITION BY l_partkey, pos ORDER BY l_shipmode) = 1) GROUP BY 1)
       SELECT coalesce(o.k, n.k) AS l_partkey, o.t AS old_title, n.t AS new_title, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed'
         WHEN o.t <> n.t THEN 'changed' ELSE 'common' END AS change FROM o FULL OUTER JOIN n ON o.k = n.k""",
)
def snapshot_diff_batches(spark, sf):
    """Two catalogues collected in batches, each id listed many times: first listing wins, then diff."""
    lines = table(spark, sf, "lineitem").select(
        "l_partkey", "l_quantity", "l_discount", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"),
        F.concat("l_returnflag", "l_linestatus").alias("title"),
    )
    old = lines.filter("l_quantity < 25").select("l_partkey", "title", "pos")
    new = lines.filter("l_discount > 0.04").select("l_partkey", "title", "pos")
    diff = R.snapshot_diff(old, new, "l_partkey", compare=["title"], order=["pos", "title"])
    return diff.select("l_partkey", "old_title", "new_title", "change")


@query(
    "change_report",
    SNAPSHOTS
    + """SELECT change, session_id, coalesce(new_title, old_title) AS title, coalesce(new_url, old_url) AS url
         FROM diff WHERE change <> 'common'""",
)
def change_report(spark, sf):
    old, new = snapshots(spark, sf)
    return R.change_list(R.snapshot_diff(old, new, "session_id"), "session_id", ["title", "url"])


@query(
    "change_stats",
    SNAPSHOTS
    + """SELECT count(*) FILTER (change <> 'added') AS previously, count(*) FILTER (change <> 'removed') AS now,
         count(*) FILTER (change = 'added') - count(*) FILTER (change = 'removed') AS net_change,
         count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
         count(*) FILTER (change = 'common') AS common FROM diff""",
)
def change_stats(spark, sf):
    old, new = snapshots(spark, sf)
    return R.diff_stats(R.snapshot_diff(old, new, "session_id"))


@query(
    "pending_inputs",
    """SELECT c_custkey, c_name FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)""",
)
def pending_inputs(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.pending(table(spark, sf, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@query(
    "named_only",
    """SELECT c_custkey, c_nationkey FROM customer
       WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""",
)
def named_only(spark, sf):
    names = table(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return R.named_only(table(spark, sf, "customer"), names, "c_nationkey").select("c_custkey", "c_nationkey")


def _live_titles(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("session_id"), "text", "lang", "source")
    stored = docs.select("session_id", F.col("text").alias("title"), F.col("source").alias("url"))
    live = docs.select(
        "session_id",
        F.when(F.col("lang") == "de", F.concat(F.lit("New: "), "text"))
        .when(F.col("lang") == "fr", F.concat(F.lit("  "), F.translate("text", ascii_lowercase, ascii_uppercase), F.lit("\n")))
        .when(F.col("lang") == "es", F.lit(""))
        .otherwise(F.col("text"))
        .alias("title"),
    )
    return stored, live


LIVE = """
WITH live AS (
  SELECT doc_id, text, source, lang,
    CASE lang WHEN 'de' THEN 'New: ' || text WHEN 'fr' THEN '  ' || translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || chr(10) WHEN 'es' THEN ''
    ELSE text END AS title FROM documents),
cmp AS (
  SELECT doc_id, text, source, regexp_replace(lower(title), '^\\s+|\\s+$', '', 'g') AS l,
         regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS s FROM live)
"""


@query(
    "title_mismatch",
    LIVE + "SELECT doc_id AS session_id, text AS title, source AS url, l AS live_title FROM cmp WHERE l <> '' AND l <> s",
)
def title_mismatch(spark, sf):
    stored, live = _live_titles(spark, sf)
    return R.value_mismatch(stored, live, "session_id", "title")


@query(
    "mismatch_report",
    LIVE
    + """, ids AS (SELECT DISTINCT source FROM cmp WHERE l <> '' AND l <> s)
    SELECT i.source, coalesce(d.lang, '') AS lang, coalesce(d.text, '') AS text FROM ids i LEFT JOIN (
      SELECT source, lang, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) d
    ON i.source = d.source AND rn = 1""",
)
def mismatch_report(spark, sf):
    stored, live = _live_titles(spark, sf)
    wrong = R.value_mismatch(stored, live, "session_id", "title").select(F.col("url").alias("source"))
    return R.mismatch_report(wrong, table(spark, sf, "documents"), "source", ["lang", "text"], ["doc_id"])


def _flag_lists(spark, sf):
    # lines of the other status go to keys that no order has, so some orders have no list
    key = F.when(F.col("l_linestatus") == "F", F.col("l_orderkey")).otherwise(-1 - F.col("l_orderkey"))
    lines = table(spark, sf, "lineitem").withColumn("l_orderkey", key)
    lists = distinct_lists(lines, "l_orderkey", "l_returnflag", ["l_linenumber"], "people")
    return lists.withColumnRenamed("l_orderkey", "o_orderkey")


FLAG_LIST_SQL = """
flags AS (
  SELECT l_orderkey, string_agg(l_returnflag, '|' ORDER BY pos, l_returnflag) AS flags FROM (
    SELECT l_orderkey, l_returnflag, min(l_linenumber) AS pos
    FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2) GROUP BY 1)
"""


@query(
    "detail_enrichment",
    "WITH "
    + FLAG_LIST_SQL
    + """SELECT o_orderkey, CASE WHEN flags IS NULL THEN '' ELSE 'room ' || split_part(flags, '|', 1) END AS room,
         coalesce(flags, o_orderstatus) AS people FROM orders LEFT JOIN flags ON o_orderkey = l_orderkey""",
)
def detail_enrichment(spark, sf):
    details = _flag_lists(spark, sf).withColumn("room", F.concat(F.lit("room "), F.get("people", 0)))
    rows = table(spark, sf, "orders").select("o_orderkey", F.array("o_orderstatus").alias("people"))
    out = R.enrich(rows, details, "o_orderkey", ["room"], "people", ["o_orderkey"])
    return out.select("o_orderkey", "room", F.array_join("people", "|").alias("people"))


@query(
    "attach_themes",
    """WITH t AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) AS themes
                  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
       SELECT c_custkey, coalesce(themes, '') AS themes FROM customer LEFT JOIN t ON c_custkey = o_custkey""",
)
def attach_themes(spark, sf):
    # orders of another status go to keys that no customer has
    key = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(-1 - F.col("o_custkey"))
    orders = table(spark, sf, "orders").withColumn("o_custkey", key)
    lists = distinct_lists(orders, "o_custkey", "o_orderpriority", ["o_orderpriority"], "themes")
    lists = lists.withColumnRenamed("o_custkey", "c_custkey")
    out = R.attach_list(table(spark, sf, "customer").select("c_custkey"), lists, "c_custkey", "themes", ["c_custkey"])
    return out.select("c_custkey", F.array_join("themes", " | ").alias("themes"))


@query(
    "fill_missing",
    """WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN ''
                  WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE 'https://' || lower(c_mktsegment) || '.com/' END AS url FROM customer),
       f AS (SELECT n_nationkey, 'https://' || lower(n_name) || '.com/' AS found FROM nation WHERE n_regionkey <> 3)
       SELECT c_custkey, CASE WHEN coalesce(url, '') = '' AND found IS NOT NULL THEN found ELSE url END AS company_url,
              coalesce(url, '') = '' AND found IS NOT NULL AS updated
       FROM c LEFT JOIN f ON c_nationkey = n_nationkey""",
)
def fill_missing(spark, sf):
    segment = F.col("c_mktsegment")
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_nationkey").alias("n"),
        F.when(segment.isin("BUILDING", "MACHINERY"), "")
        .when(segment != "FURNITURE", F.concat(F.lit("https://"), F.lower(segment), F.lit(".com/")))
        .alias("company_url"),
    )
    found = table(spark, sf, "nation").filter("n_regionkey <> 3").select(
        F.col("n_nationkey").alias("n"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".com/")).alias("company_url"),
        F.lit(2).alias("at"),
    )
    found = found.unionByName(found.withColumns({"company_url": F.lit("https://old.com/"), "at": F.lit(1)}))
    return R.fill_missing(rows, found, "n", "company_url", ["c_custkey"], ["at"]).drop("n")


def _schedule(spark, sf):
    orders = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    rows = orders.select(
        "o_orderkey",
        F.when(status == "P", "").otherwise(F.date_format("o_orderdate", DAY)).alias("date"),
        F.when(status == "O", None).otherwise(F.col("o_orderpriority")).alias("time"),
        F.lit("hall").alias("location"),
    )
    patch = orders.filter("o_orderpriority <> '5-LOW'").select(
        "o_orderkey",
        F.when(status == "F", "").otherwise(F.lit("2026-01-01")).alias("date"),
        F.lit("09:00").alias("time"),
        F.when(status == "O", "").otherwise(F.lit("room")).alias("location"),
        F.lit(2).alias("at"),
    )
    # each key was patched before, in a row that the later one overwrites
    earlier = patch.select("o_orderkey", F.lit("1999-12-31").alias("date"), F.lit("").alias("time"), F.lit("zoo").alias("location"), F.lit(1).alias("at"))
    return rows, patch.unionByName(earlier)


SCHEDULE = """
WITH r AS (SELECT o_orderkey, o_orderpriority AS pr, o_orderstatus AS st,
             CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
             CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS time, 'hall' AS location FROM orders),
p AS (SELECT *, CASE WHEN st = 'F' THEN '' ELSE '2026-01-01' END AS pd, '09:00' AS pt,
             CASE WHEN st = 'O' THEN '' ELSE 'room' END AS pl, pr <> '5-LOW' AS hit FROM r)
"""


@query(
    "patch_fill",
    SCHEDULE
    + """SELECT o_orderkey, CASE WHEN hit AND pd <> '' THEN pd ELSE date END AS date, CASE WHEN hit THEN pt ELSE time END AS time,
         CASE WHEN hit AND pl <> '' THEN pl ELSE location END AS location FROM p""",
)
def patch_fill(spark, sf):
    rows, patch = _schedule(spark, sf)
    return R.patch_columns(rows, patch, "o_orderkey", ["date", "time", "location"], "fill", ["at"])


@query(
    "patch_overwrite",
    SCHEDULE
    + """SELECT o_orderkey, CASE WHEN hit THEN pd ELSE date END AS date, CASE WHEN hit THEN pt ELSE time END AS time,
         CASE WHEN hit THEN pl ELSE location END AS location FROM p""",
)
def patch_overwrite(spark, sf):
    rows, patch = _schedule(spark, sf)
    return R.patch_columns(rows, patch, "o_orderkey", ["date", "time", "location"], "overwrite", ["at"])


@query(
    "replace_rows",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'
         THEN 'fresh ' || o_orderstatus ELSE o_orderpriority END AS title,
         strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders""",
)
def replace_rows(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.select("o_orderkey", F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", DAY).alias("date"))
    fresh = orders.filter("o_orderpriority in ('1-URGENT', '2-HIGH')").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")).alias("found_id"),
        F.concat(F.lit("fresh "), "o_orderstatus").alias("title"),
        F.lit(2).alias("at"),
    )
    first_try = fresh.withColumns({"found_id": F.col("o_orderkey"), "title": F.lit("first try"), "at": F.lit(1)})
    return R.replace_rows(rows, fresh.unionByName(first_try), "o_orderkey", ["date"], "found_id", ["at"])


@query(
    "day_lookup",
    """SELECT n_nationkey, n_name, coalesce(r_name, '') AS r_name FROM nation
       LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""",
)
def day_lookup(spark, sf):
    days = table(spark, sf, "region").filter("r_regionkey < 3").withColumnRenamed("r_regionkey", "n_regionkey")
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return R.lookup(rows, days, "n_regionkey", "r_name").drop("n_regionkey")


@query(
    "check_references",
    """WITH n AS (SELECT l_orderkey AS o, l_suppkey AS s, p_name AS t, min(l_linenumber) AS pos
                  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
            named AS (SELECT o, t, min(pos) AS pos FROM n GROUP BY 1, 2),
            k AS (SELECT DISTINCT p_name FROM part WHERE p_size > 45 AND p_type IN ('PROMO', 'SMALL'))
       SELECT o AS l_orderkey,
         coalesce(string_agg(t, '|' ORDER BY pos, t) FILTER (p_name IS NOT NULL), '') AS resolved,
         coalesce(string_agg(t, '|' ORDER BY pos, t) FILTER (p_name IS NULL), '') AS dangling
       FROM named LEFT JOIN k ON t = p_name GROUP BY 1""",
)
def check_references(spark, sf):
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    # many lines share a part: salted join, then one row per order with its ordered titles
    named = skew_join(lines, part.select("p_partkey", "p_name"), ["p_partkey"], ["l_orderkey", "l_linenumber"], "inner")
    rows = distinct_lists(named, "l_orderkey", "p_name", ["l_linenumber"], "titles")
    known = part.filter("p_size > 45 and p_type in ('PROMO', 'SMALL')")
    out = R.check_references(rows, "l_orderkey", "titles", known, "p_name")
    return out.select(
        "l_orderkey",
        F.array_join("resolved", "|").alias("resolved"),
        F.array_join("dangling", "|").alias("dangling"),
    )


@query(
    "upsert_stored",
    """WITH u AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn
                  FROM orders WHERE o_orderstatus = 'P')
       SELECT coalesce(c_custkey, o_custkey) AS session_id, coalesce(o_orderpriority, c_mktsegment) AS title,
         CASE WHEN o_custkey IS NULL THEN c_name END AS speaker
       FROM customer FULL OUTER JOIN (SELECT * FROM u WHERE rn = 1) ON c_custkey = o_custkey""",
)
def upsert_stored(spark, sf):
    """A stored table, updated in the buckets that the updates touch."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("title"), F.col("c_name").alias("speaker"))
    updates = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("at")
    )
    stored = StoredTable(spark, work_dir(spark, "stored"), "session_id").create(base)
    stored.upsert(updates, ["at"])
    return stored.read()


@query(
    "upsert",
    """WITH u AS (SELECT o_custkey, o_orderkey, o_orderpriority,
                    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'O')
       SELECT coalesce(c_custkey, o_custkey) AS session_id, coalesce(o_orderpriority, c_mktsegment) AS title
       FROM customer FULL OUTER JOIN (SELECT * FROM u WHERE rn = 1) ON c_custkey = o_custkey""",
)
def upsert(spark, sf):
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("title"), F.lit(None).cast("long").alias("at")
    )
    updates = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("at")
    )
    return R.upsert(base, updates, "session_id", ["at"]).select("session_id", "title")


@query(
    "column_override",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'index ' || o_orderpriority ELSE 'page' END AS session_type FROM orders""",
)
def column_override(spark, sf):
    orders = table(spark, sf, "orders")
    pages = orders.select("o_orderkey", F.lit("page").alias("session_type"))
    index = orders.filter("o_orderstatus <> 'F'").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("index "), "o_orderpriority")).otherwise("").alias("session_type"),
        F.lit(2).alias("at"),
    )
    index = index.unionByName(index.withColumns({"session_type": F.lit("first listed"), "at": F.lit(1)}))
    return R.override_column(pages, index, "o_orderkey", "session_type", ["at"])


NATION_URLS = """
WITH n AS (SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'Simplismart' WHEN 1 THEN 'Wistron & Wiwynn'
             WHEN 2 THEN 'LightWheel' ELSE n_name || ' GmbH' END AS name FROM nation)
SELECT n_nationkey, name, CASE lower(name) WHEN 'simplismart' THEN 'https://www.simplismart.ai/'
  WHEN 'wistron & wiwynn' THEN 'https://www.wiwynn.com/' WHEN 'lightwheel' THEN 'https://www.lightwheel.ai/'
  ELSE 'https://www.' || regexp_replace(lower(replace(name, ' GmbH', '')), '[^a-z0-9]', '', 'g') || '.com/' END AS company_url FROM n
"""


@query("url_override", NATION_URLS)
def url_override(spark, sf):
    region = F.col("n_regionkey")
    rows = table(spark, sf, "nation").select(
        "n_nationkey",
        F.when(region == 0, "Simplismart")
        .when(region == 1, "Wistron & Wiwynn")
        .when(region == 2, "LightWheel")
        .otherwise(F.concat("n_name", F.lit(" GmbH")))
        .alias("name"),
    )
    known = spark.createDataFrame(list(KNOWN_COMPANIES.items()), "name string, value string")
    return R.override_by_name(rows, known, "name", company_url(F.col("name")), "company_url")


@query(
    "url_override_table",
    """SELECT c_custkey, c_name, CASE WHEN o_custkey IS NULL THEN 'https://www.' || regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || '.com/'
         ELSE '/orders/' || last_order END AS company_url
       FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def url_override_table(spark, sf):
    """Special cases from a table as large as the names, each entered many times: the last entry counts."""
    names = table(spark, sf, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf, "orders")
    known = orders.select(
        F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"),
        F.concat(F.lit("/orders/"), "o_orderkey").alias("value"), "o_orderkey",
    )
    return R.override_by_name(names, known, "c_name", company_url(F.col("c_name")), "company_url", ["o_orderkey"])


@query(
    "verify_and_replace",
    """SELECT doc_id AS session_id, CASE WHEN lang = 'de' THEN 'New: ' || text ELSE text END AS title, source AS url FROM documents""",
)
def verify_and_replace(spark, sf):
    """Titles that changed on their pages are extracted anew; the url stays as stored."""
    stored, live = _live_titles(spark, sf)
    pages = live.select("session_id", F.concat(F.lit("<h1>"), F.col("title"), F.lit("</h1>")).alias("html"))

    def extract(pages):
        title = F.regexp_extract("html", "(?s)^<h1>(.*)</h1>$", 1)
        return pages.select("session_id", F.col("session_id").alias("found_id"), title.alias("title"), F.lit("lost").alias("url"))

    return R.verify_and_replace(stored, live, pages, "session_id", "title", ["url"], extract)


@query(
    "keyed_table",
    """SELECT o_custkey, o_orderkey, o_orderpriority FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def keyed_table(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return last_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")
