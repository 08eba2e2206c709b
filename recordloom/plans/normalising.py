"""Unicode, clock and date text, titles, people, company URLs, and the published formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import lists as L
from recordloom.functions import schedule as S
from recordloom.functions import text as X
from recordloom.functions import urls as U
from recordloom.operators import normalize as N
from recordloom.operators.dedup import distinct_lists
from recordloom.operators.scale import skew_join
from recordloom.plans.registry import query, table

STRIP = r"'^\s+|\s+$', '', 'g'"


def _marked(spark, sf):
    """The documents with typographic marks put in."""
    text = F.replace(F.replace("text", F.lit(". "), F.lit("… ")), F.lit(" the "), F.lit(" ‘the’ “​” "))
    text = F.replace(F.replace(text, F.lit(" de "), F.lit("–de—")), F.lit("\n"), F.lit(" ⋅x000D "))
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


MARKED = """replace(replace(replace(replace({0}, '. ', '{1}'), ' the ', '{2}'), ' de ', '{3}'), chr(10), '{4}')"""


@query(
    "unicode_marks",
    "SELECT doc_id, " + MARKED.format("text", "... ", " ''the'' \"\" ", "-de-", " ⋅x000D ") + " AS text FROM documents",
)
def unicode_marks(spark, sf):
    return _marked(spark, sf).select("doc_id", X.replace_marks(F.col("text")).alias("text"))


@query(
    "unicode_clean",
    "SELECT doc_id, nfc_normalize(" + MARKED.format("text", "... ", " ''the'' \"\" ", "-de-", " ⋅x000D ") + ") AS text FROM documents",
)
def unicode_clean(spark, sf):
    return X.clean_frame(_marked(spark, sf))


@query("unicode_compatibility", "SELECT doc_id, nfc_normalize('fi Ab 2 kg ガ é ' || text) AS text FROM documents")
def unicode_compatibility(spark, sf):
    """Ligatures, full-width letters, superscripts, square units, half-width kana and loose accents."""
    marked = F.concat(F.lit("ﬁ Ａｂ ² ㎏ ｶﾞ e\u0301 "), "text")
    return table(spark, sf, "documents").select("doc_id", X.clean_text(marked).alias("text"))


@query(
    "unicode_clean_nested",
    "SELECT doc_id, nfc_normalize(" + MARKED.format("text", "... ", " ''the'' \"\" ", "-de-", " ⋅x000D ") + ") AS text FROM documents",
)
def unicode_clean_nested(spark, sf):
    nested = _marked(spark, sf).select("doc_id", F.array(F.struct(F.col("text").alias("t"), F.lit(1).alias("n"))).alias("items"))
    out = X.clean_frame(nested, "no_line_separators")
    # NFKC leaves the line separators alone
    return out.select("doc_id", F.col("items")[0]["t"].alias("text"))


@query(
    "unicode_clean_collapsed",
    r"""SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize("""
    + MARKED.format("text", "... ", " ''the'' \"\" ", "-de-", " * x000D ")
    + r"""), '\bx000D\b', '', 'g'), '\s+', ' ', 'g').trim() AS text FROM documents""",
)
def unicode_clean_collapsed(spark, sf):
    # the artifact stands alone once the dot operator has become ' * '
    return X.clean_frame(_marked(spark, sf), "collapsed")


def _h12():
    return ((F.hour("ts") + 11) % 12 + 1).cast("string")


H12 = "((hour(ts) + 11) % 12 + 1)"
MM = "lpad(CAST(minute(ts) AS VARCHAR), 2, '0')"


@query(
    "clock_24h",
    f"""SELECT event_id, CASE event_type WHEN 'signup' THEN '12:00' WHEN 'error' THEN '' WHEN 'click' THEN strftime(ts, '%H') || ':00'
          ELSE strftime(ts, '%H:%M') END AS clock FROM events""",
)
def clock_24h(spark, sf):
    kind = F.col("event_type")
    half = F.when(F.hour("ts") >= 12, "p.m.").otherwise("a.m.")
    text = (
        F.when(kind == "signup", "12 noon")
        .when(kind == "error", "soon")
        .when(kind == "click", F.concat(_h12(), F.lit(" "), F.upper(F.replace(half, F.lit("."), F.lit("")))))
        .when(kind == "view", F.date_format("ts", "HH:mm"))
        .otherwise(F.concat(F.lit(" "), _h12(), F.lit(":"), F.date_format("ts", "mm"), F.lit(" "), half, F.lit("\n")))
    )
    return table(spark, sf, "events").select("event_id", S.clock_24h(text).alias("clock"))


@query(
    "time_range",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%H:%M') END AS start,
         CASE WHEN event_type = 'error' THEN '' ELSE '14:30' END AS "end" FROM events""",
)
def time_range(spark, sf):
    half = F.when(F.hour("ts") >= 12, "p.m.").otherwise("A.M.")
    dash = F.when(F.col("event_type") == "view", " -- ").when(F.col("event_type") == "click", " — ").otherwise("  - ")
    text = F.concat(
        F.lit("Tue 19 May "), _h12(), F.lit(":"), F.date_format("ts", "mm"), F.lit(" "), half, F.lit(" PDT"), dash,
        F.when(F.col("event_type") == "error", "late").otherwise("2:30 p.m. PDT"),
    )
    out = table(spark, sf, "events").select("event_id", S.time_range(text).alias("r"))
    return out.select("event_id", "r.start", "r.end")


@query(
    "date_line",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND month(o_orderdate) <> 5 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
         '08:45' AS start, CASE WHEN o_orderstatus = 'O' THEN '21:05' ELSE '09:05' END AS "end" FROM orders""",
)
def date_line(spark, sf):
    month = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "MMM")).otherwise(F.date_format("o_orderdate", "MMMM"))
    text = F.concat(
        F.date_format("o_orderdate", "EEE"), F.lit(", "), month, F.lit(" "), F.dayofmonth("o_orderdate"), F.lit(", "),
        F.year("o_orderdate"), F.lit(" * 8:45 AM – 9:05 "), F.when(F.col("o_orderstatus") == "O", "pm").otherwise("AM"), F.lit(" PDT"),
    )
    out = table(spark, sf, "orders").select("o_orderkey", S.date_line(text).alias("d"))
    return out.select("o_orderkey", "d.date", "d.start", "d.end")


@query(
    "short_date_line",
    """SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%m-%d') = '02-29' THEN '' ELSE '2026' || strftime(o_orderdate, '-%m-%d') END AS date,
         CASE o_orderstatus WHEN 'O' THEN '08:30' WHEN 'F' THEN '11:30' ELSE '13:15' END AS start,
         CASE o_orderstatus WHEN 'O' THEN '09:30' WHEN 'F' THEN '12:30' ELSE '14:00' END AS "end" FROM orders""",
)
def short_date_line(spark, sf):
    orders = table(spark, sf, "orders")
    # 29 February is no date in 2026
    status = F.col("o_orderstatus")
    times = F.when(status == "O", "8:30 - 9:30 AM").when(status == "F", "11:30 - 12:30 PM").otherwise("1:15 – 2 pm")
    text = F.concat(F.date_format("o_orderdate", "EEEE, MMMM d"), F.lit(" | "), times)
    out = orders.select("o_orderkey", S.short_date_line(text, 2026).alias("d"))
    return out.select("o_orderkey", "d.date", "d.start", "d.end")


@query(
    "end_time",
    f"""SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE {H12} || ':' || {MM} || ' PM' END AS end_time,
         CASE WHEN event_type = 'error' THEN '' ELSE {H12} || ':' || {MM} || ' PM' END AS end_note FROM events""",
)
def end_time(spark, sf):
    note = F.when(F.col("event_type") == "error", "(open)").otherwise(
        F.concat(F.lit("(ends "), _h12(), F.lit(":"), F.date_format("ts", "mm"), F.lit(" PM)"))
    )
    return table(spark, sf, "events").select(
        "event_id", S.end_time(note).alias("end_time"), S.end_note(note).alias("end_note")
    )


@query(
    "clean_title",
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_name ELSE p_type || ' [x] ' || p_brand END AS title FROM part""",
)
def clean_title(spark, sf):
    detail = F.when(F.col("p_type") == "PROMO", "").otherwise(F.concat(F.lit(" "), "p_type", F.lit("  [x]\n"), "p_brand", F.lit(" [8:30 – 10:00] ")))
    calendar = F.concat("p_name", F.lit(" [08:30-10:00]"))
    return table(spark, sf, "part").select("p_partkey", N.clean_title(detail, calendar).alias("title"))


@query(
    "type_topic_track",
    """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Keynote' WHEN 'SMALL' THEN 'Invited Talk' WHEN 'LARGE' THEN 'Invited Talk'
           WHEN 'MEDIUM' THEN 'Paper Session' WHEN 'STANDARD' THEN 'Paper Session' ELSE 'Session' END AS type,
         CASE WHEN p_type IN ('MEDIUM', 'STANDARD') THEN 'R1: ' || p_name ELSE p_name END AS topic,
         CASE p_type WHEN 'MEDIUM' THEN 'Research-Track' WHEN 'STANDARD' THEN 'Industry-Track' ELSE '' END AS track FROM part""",
)
def type_topic_track(spark, sf):
    t = F.col("p_type")
    kind = F.when(t.isin("SMALL", "PROMO"), "invited-talk").otherwise("session")
    label = F.when(t == "PROMO", "Keynote Talk").when(t == "LARGE", "Invited Talk").otherwise("Session")
    title = (
        F.when(t == "MEDIUM", F.concat(F.lit("Research-Track Oral Presentation:  R1: "), "p_name"))
        .when(t == "STANDARD", F.concat(F.lit("Industry-Track Oral Presentation: R1: "), "p_name"))
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        N.entry_type(kind, label, title).alias("type"),
        N.entry_topic(title).alias("topic"),
        N.entry_track(title).alias("track"),
    )


@query(
    "split_people",
    "SELECT p_partkey, p_name || '; ' || p_brand || '; ' || p_type AS people FROM part",
)
def split_people(spark, sf):
    text = F.concat(F.lit(" * "), "p_name", F.lit(", * ,* "), "p_brand", F.lit(" ** "), "p_type", F.lit(",*"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(L.split_people(text), "; ").alias("people"))


def _entries(spark, sf):
    """Calendar entries from orders; their papers are the brands on the order."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    # lines with another flag go to keys that no order has, so some entries list no papers
    key = F.when(F.col("l_returnflag") == "A", F.col("l_orderkey")).otherwise(-1 - F.col("l_orderkey"))
    lines = table(spark, sf, "lineitem").select(key.alias("l_orderkey"), "l_linenumber", "l_partkey")
    named = skew_join(lines, part, ["l_partkey"], ["l_orderkey", "l_linenumber"], "inner")
    brands = distinct_lists(named, "l_orderkey", "p_brand", ["l_linenumber"], "brands")
    orders = table(spark, sf, "orders")
    joined = orders.join(brands, orders.o_orderkey == brands.l_orderkey, "left")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    papers = F.transform(
        F.coalesce("brands", F.array().cast("array<string>")),
        lambda b: F.struct(
            b.alias("title"),
            F.concat(F.lit("/oral/"), b).alias("url"),
            F.concat(F.lit("Ann * "), b, F.lit(", *")).alias("authors"),
            F.when(b == "Brand#1", "").otherwise(F.concat(F.lit("about "), b)).alias("abstract"),
        ),
    )
    talk = status == "P"
    detail = F.struct(
        F.when(talk, F.concat(F.lit("Talk "), priority)).otherwise("").alias("title"),
        F.when(priority == "5-LOW", "").otherwise("Room 1").alias("room"),
        F.when(talk, "Mon, May 18, 2026 * 8:45 AM - 9:05 AM PDT").alias("date_line"),
        F.when(status == "F", "Tue 19 May 1 p.m. PDT — 2:30 p.m. PDT").alias("time_line"),
        F.when(priority == "1-URGENT", " Dr Who ").otherwise("").alias("speaker"),
        F.lit("the abstract").alias("abstract"),
        F.when(~talk, papers).alias("papers"),
    )
    title = F.when(status == "F", F.concat(F.lit("Research-Track Oral Presentation: "), priority, F.lit(" [8:30-10:00]"))).otherwise(
        F.concat(F.lit("Posters "), priority)
    )
    return joined.select(
        "o_orderkey",
        F.when(talk, "invited-talk").otherwise("session").alias("kind"),
        F.when(talk & (priority == "2-HIGH"), "Keynote Talk").otherwise("").alias("kind_label"),
        title.alias("title"),
        F.when(status == "O", "WED 20 MAY").otherwise("TUE 19 MAY").alias("day"),
        F.lit("8 a.m.").alias("start_raw"),
        F.lit("").alias("end_raw"),
        F.concat(F.lit("/entry/"), "o_orderkey").alias("url"),
        F.lit("Cal Speaker").alias("speaker_on_calendar"),
        detail.alias("detail"),
    )


DATES = {"TUE 19 MAY": "2026-05-19", "WED 20 MAY": "2026-05-20"}

SESSIONS = """
WITH b AS (SELECT l_orderkey, p_brand, min(l_linenumber) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey
           WHERE l_returnflag = 'A' GROUP BY 1, 2),
l AS (SELECT l_orderkey, string_agg(p_brand, ';' ORDER BY pos, p_brand) AS brands FROM b GROUP BY 1),
e AS (SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, l.brands,
        CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'Room 1' END AS location FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
s AS (
 SELECT o_orderkey, 'Talk ' || pr AS title, CASE WHEN pr = '2-HIGH' THEN 'Keynote' ELSE 'Invited Talk' END AS type, '2026-05-18' AS date,
   '08:45' AS "startTime", '09:05' AS "endTime", location, '/entry/' || o_orderkey AS "sessionUrl", 'Talk ' || pr AS topic,
   CASE WHEN pr = '1-URGENT' THEN 'Dr Who' ELSE 'Cal Speaker' END AS speaker, 'the abstract' AS abstract, NULL AS pubs FROM e WHERE st = 'P'
 UNION ALL SELECT e.o_orderkey, p_brand, 'Oral Session', '2026-05-19', '13:00', '14:30', location, '/oral/' || p_brand,
   'Research-Track;' || pr, 'Ann;' || p_brand, CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE 'about ' || p_brand END, NULL
   FROM e JOIN b ON l_orderkey = o_orderkey WHERE st = 'F'
 UNION ALL SELECT o_orderkey, 'Research-Track Oral Presentation: ' || pr, 'Paper Session', '2026-05-19', '13:00', '14:30', location,
   '/entry/' || o_orderkey, pr, 'Cal Speaker', NULL, NULL FROM e WHERE st = 'F' AND brands IS NULL
 UNION ALL SELECT o_orderkey, 'Posters ' || pr, 'Session', '2026-05-20', '08:00', '', location, '/entry/' || o_orderkey, 'Posters ' || pr,
   CASE WHEN brands IS NULL THEN 'Cal Speaker' ELSE 'Ann;' || brands END, NULL, brands FROM e WHERE st = 'O')
"""


@query(
    "normalize_sessions",
    SESSIONS
    + """SELECT o_orderkey, title, type, date, "startTime", "endTime", location, "sessionUrl", topic, speaker, abstract, pubs,
         'IN_PERSON' AS "sessionFormat", false AS "hasRecording" FROM s""",
)
def normalize_sessions(spark, sf):
    out = N.normalize_entries(_entries(spark, sf), DATES)
    return out.withColumns(
        {
            "topic": F.array_join("topic", ";"),
            "speaker": F.array_join("speaker", ";"),
            "pubs": F.array_join("publicationTitles", ";"),
        }
    ).drop("publicationTitles")


@query(
    "to_flat_sessions",
    SESSIONS
    + """SELECT title, date, "startTime" AS start, "endTime" AS "end", type AS session_type, replace(topic, 'Research-Track;', '') AS topic,
         "sessionUrl" AS url, 'In-Person' AS format, speaker AS speakers, nullif(location, '') AS room, topic AS key_themes FROM s""",
)
def to_flat_sessions(spark, sf):
    out = N.to_flat_sessions(N.normalize_entries(_entries(spark, sf), DATES))
    return out.withColumns(
        {
            "speakers": F.array_join(F.transform("speakers", lambda s: s["name"]), ";"),
            "key_themes": F.array_join("key_themes", ";"),
        }
    )


def _companies(spark, sf):
    ending = (
        F.when(F.col("c_nationkey") < 5, " Corp. Inc.").when(F.col("c_nationkey") < 10, " Company Ltd")
        .when(F.col("c_nationkey") < 15, ".com").when(F.col("c_nationkey") < 20, " (Group) AG").otherwise("")
    )
    return table(spark, sf, "customer").select("c_custkey", F.concat("c_name", ending).alias("name"))


COMPANIES = """
WITH c AS (SELECT c_custkey, c_nationkey AS k, c_name || CASE WHEN c_nationkey < 5 THEN ' Corp. Inc.' WHEN c_nationkey < 10 THEN ' Company Ltd'
   WHEN c_nationkey < 15 THEN '.com' WHEN c_nationkey < 20 THEN ' (Group) AG' ELSE '' END AS name,
   lower(replace(c_name, '#', '')) AS core FROM customer)
"""


@query(
    "company_url",
    COMPANIES
    + """SELECT c_custkey, name, 'https://www.' || core || CASE WHEN k >= 10 AND k < 15 THEN 'com' WHEN k >= 15 AND k < 20 THEN 'group'
           ELSE '' END || '.com/' AS company_url FROM c""",
)
def company_url(spark, sf):
    return _companies(spark, sf).withColumn("company_url", U.company_url(F.col("name")))


@query("company_url_strict", COMPANIES + "SELECT c_custkey, name, 'https://www.' || core || '.com/' AS company_url FROM c")
def company_url_strict(spark, sf):
    return _companies(spark, sf).withColumn("company_url", U.company_url(F.col("name"), strict=True))


@query(
    "url_priority",
    """SELECT s_suppkey, CASE WHEN s_nationkey > 12 THEN 'https://found.org/' || s_suppkey
         ELSE 'https://www.' || lower(replace(s_name, '#', '')) || '.com/' END AS company_url FROM supplier""",
)
def url_priority(spark, sf):
    found = F.when(F.col("s_nationkey") > 12, F.concat(F.lit("https://found.org/"), "s_suppkey")).when(F.col("s_nationkey") > 6, "")
    generated = U.company_url(F.concat("s_name", F.lit(" GmbH")), strict=True)
    return table(spark, sf, "supplier").select("s_suppkey", X.first_value(found, generated).alias("company_url"))
