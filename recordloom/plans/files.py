"""Round trips through the file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators.dedup import distinct_lists
from recordloom.plans.registry import query, table
from recordloom.session import work_dir
from recordloom.sources import files, sinks


def _ddl(df):
    return ", ".join(f"{name} {dtype}" for name, dtype in df.dtypes)


@query(
    "json_array_source",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders",
)
def json_array_source(spark, sf):
    """Upload batches of at most 1000 records, written as arrays and read back."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    path = work_dir(spark, "arrays")
    sinks.write_record_arrays(rows, path, "o_orderkey")
    return files.read_records(spark, path, _ddl(rows))


@query(
    "record_array_sizes",
    "SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS batch, count(*) OVER () AS total FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 1000 = 0",
)
def record_array_sizes(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    arrays = sinks.record_arrays(rows, "o_orderkey")
    # the arrays hold every record: lengths add up to the number of orders
    sizes = arrays.select("batch", F.json_array_length("value").alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.select("batch", total.alias("total"))


@query(
    "envelope_source",
    "SELECT c_mktsegment AS venue, CAST(2026 AS INTEGER) AS year, c_custkey, c_name AS title FROM customer",
)
def envelope_source(spark, sf):
    rows = table(spark, sf, "customer")
    sessions = rows.select("c_custkey", F.col("c_name").alias("title"), "c_mktsegment")
    path = work_dir(spark, "envelopes")
    sinks.write_envelopes(sessions, path, "sessions", "c_custkey", F.col("c_mktsegment"), F.lit(2026))
    item = "c_custkey long, title string"
    return files.read_envelope(spark, path, "sessions", item)


@query(
    "nested_map_source",
    """WITH d AS (SELECT DISTINCT p_brand, p_type, p_name FROM part)
       SELECT p_brand AS unit, p_type AS category, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS INTEGER) AS category_pos,
         p_name AS text, CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_name) - 1 AS INTEGER) AS text_pos FROM d""",
)
def nested_map_source(spark, sf):
    """Part names by brand and type, written as one nested map per brand."""
    part = table(spark, sf, "part").withColumn("bt", F.struct("p_brand", "p_type"))
    lists = distinct_lists(part, "bt", "p_name", ["p_name"], "texts").select("bt.*", "texts")
    inner = F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_type", "texts"))))
    maps = lists.groupBy("p_brand").agg(inner.alias("categories"))
    path = work_dir(spark, "maps")
    maps.select(F.to_json(F.create_map("p_brand", "categories")).alias("value")).write.text(path)
    return files.read_nested_map(spark, path, whole_file=False).drop("unit_pos")


@query("csv_source", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, '' AS absent FROM documents")
def csv_source(spark, sf):
    """Texts with quotes and line breaks through CSV."""
    path = work_dir(spark, "csv")
    sinks.write_csv(table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return files.read_csv(spark, path, ["doc_id", "text", "lang", "absent"])


@query(
    "text_records_source",
    r"""WITH l AS (SELECT conv_id, turn, role, list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split(text, chr(10))], lambda y: y <> '') AS l
                   FROM conversations)
        SELECT 'Talk ' || conv_id || '-' || turn AS title, CASE WHEN turn % 2 = 0 THEN role END AS authors, 'Venue ' || role AS venue,
          CAST(CASE WHEN turn = 1 THEN 0.0 ELSE turn * 0.25 END AS DOUBLE) AS affinity_score, CAST(NULL AS VARCHAR) AS link, CAST(NULL AS VARCHAR) AS keywords,
          nullif(array_to_string(l, chr(10)), '') AS bibtex FROM l WHERE role <> 'system'""",
)
def text_records_source(spark, sf):
    """Conversation turns as text records; a system turn has no title and is no record."""
    c = table(spark, sf, "conversations")
    title = F.when(F.col("role") == "system", "").otherwise(
        F.concat(F.lit("Title: Talk "), "conv_id", F.lit("-"), "turn", F.lit("\n"))
    )
    authors = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Authors: "), "role")).otherwise("Authors: ")
    score = F.when(F.col("turn") == 1, "n/a").otherwise((F.col("turn") * 0.25).cast("string"))
    record = F.concat(
        F.lit("\n"), title, authors, F.lit("\n  Venue: Venue "), "role", F.lit("\nAffinity Score: "), score,
        F.lit("\nKeywords: \nBibTeX:\n"), "text", F.lit("\n"),
    )
    path = work_dir(spark, "text")
    c.select(record.alias("value")).write.option("lineSep", files.SEPARATOR + "\n").text(path)
    return files.read_text_records(spark, path)


@query("pages_source", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n FROM pages")
def pages_source(spark, sf):
    pages = files.read_pages(spark, f"{sf}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("json_sink", "SELECT doc_id, text, lang, source FROM documents")
def json_sink(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    path = work_dir(spark, "json")
    sinks.write_json(rows, path)
    return files.read_records(spark, path, _ddl(rows))


@query(
    "flat_csv_sink",
    """WITH f AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ' | ' ORDER BY l_returnflag) AS themes FROM lineitem GROUP BY 1)
       SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderpriority AS title, coalesce(themes, '') AS key_themes,
         '[{"name":"' || o_orderstatus || ' é","title":"","company":"' || o_custkey || '"}]' AS speakers
       FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""",
)
def flat_csv_sink(spark, sf):
    orders = table(spark, sf, "orders")
    themes = distinct_lists(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ["l_returnflag"], "key_themes")
    person = F.struct(
        F.concat("o_orderstatus", F.lit(" é")).alias("name"), F.lit("").alias("title"), F.col("o_custkey").cast("string").alias("company")
    )
    rows = orders.join(themes, orders.o_orderkey == themes.l_orderkey, "left").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("title"), "key_themes",
        F.array(person).alias("speakers"), F.lit("dropped").alias("extra"),
    )
    columns = ["session_id", "title", "key_themes", "speakers"]
    path = work_dir(spark, "flat")
    sinks.write_csv(sinks.flatten(rows, columns, ["key_themes"], ["speakers"]), path)
    return files.read_csv(spark, path, columns)


@query(
    "per_unit_files",
    "SELECT p_type || '_' || p_brand || '_' AS unit, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part",
)
def per_unit_files(spark, sf):
    unit = F.concat("p_type", F.lit("/"), "p_brand", F.lit("?"))
    rows = table(spark, sf, "part").select(unit.alias("unit"), "p_partkey", "p_name")
    path = work_dir(spark, "units")
    sinks.write_per_unit(rows, path, "unit")
    return files.read_csv(spark, path, ["unit", "p_partkey", "p_name"])


@query(
    "papers_csv",
    """SELECT doc_id, '"' || replace(text, '"', '""') || '","' || lang || '","' || source || '",' ||
         CASE WHEN coalesce(quality, 0) = 0 THEN '0' ELSE doc_id || '.5' END || ',"",""' AS line
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def papers_csv(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    papers = docs.select(
        "doc_id",
        F.col("text").alias("title"),
        F.col("lang").alias("authors"),
        F.col("source").alias("venue"),
        F.when(F.col("quality") == 1, F.col("doc_id") + 0.5).alias("affinity_score"),
        F.lit(None).cast("string").alias("link"),
        F.lit("").alias("keywords"),
    )
    return sinks.paper_csv_lines(papers).select("doc_id", "line")


@query(
    "papers_csv_file",
    """SELECT text AS "Title", lang AS "Authors", source AS "Venue", CASE WHEN doc_id % 3 = 0 THEN '0' WHEN doc_id % 3 = 1 THEN CAST(doc_id AS VARCHAR)
         ELSE doc_id || '.5' END AS "Affinity Score", CAST(doc_id AS VARCHAR) AS "Link", '' AS "Keywords" FROM documents""",
)
def papers_csv_file(spark, sf):
    """The export written, and read back."""
    third = F.col("doc_id") % 3
    papers = table(spark, sf, "documents").select(
        F.col("text").alias("title"), F.col("lang").alias("authors"), F.col("source").alias("venue"),
        F.when(third == 1, F.col("doc_id").cast("double")).when(third == 2, F.col("doc_id") + 0.5).alias("affinity_score"),
        F.col("doc_id").cast("string").alias("link"), F.lit("").alias("keywords"),
    )
    path = work_dir(spark, "papers")
    sinks.write_papers_csv(papers, path)
    return files.read_csv(spark, path, sinks.PAPER_HEADERS)


@query(
    "labelled_files",
    "SELECT lang AS day, doc_id, source AS title FROM documents",
)
def labelled_files(spark, sf):
    """One folder of records per language; the label comes back from the path."""
    path = work_dir(spark, "days")
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.concat(F.lit("day_"), "lang").alias("file"))
    rows.write.partitionBy("file").json(path)
    schema = "doc_id long, title string"
    return files.read_labelled(spark, f"{path}/*", schema, r"day_(\w+)", "day")


@query(
    "union_labelled",
    """SELECT o_orderpriority AS day, o_orderkey, CASE WHEN o_orderpriority < '3' THEN o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderpriority >= '3' THEN o_custkey END AS o_custkey FROM orders""",
)
def union_labelled(spark, sf):
    """All orders in batches by priority; the first two have another column than the rest."""
    orders = table(spark, sf, "orders")
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    batches = {p: orders.filter(F.col("o_orderpriority") == p) for p in priorities}
    return files.union_labelled(
        {p: df.select("o_orderkey", "o_orderstatus" if p < "3" else "o_custkey") for p, df in batches.items()}, "day"
    )
