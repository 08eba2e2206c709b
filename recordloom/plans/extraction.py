"""Fields, lists, links and nodes from pages and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.functions import lists as L
from recordloom.functions import schedule as S
from recordloom.functions import text as X
from recordloom.functions import urls as U
from recordloom.operators import calendar as C
from recordloom.operators import extract as E
from recordloom.operators.scale import carry_forward
from recordloom.plans.registry import query, table

STRIP = r"'^\s+|\s+$', '', 'g'"
# tags and the entities of the tables removed, ends stripped
PLAIN = (
    r"regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&lt;', '<'), "
    r"'&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '^\s+|\s+$', '', 'g')"
)
LINKS = (
    r"(SELECT page_id, url AS page_url, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS pos FROM "
    r"(SELECT page_id, url, regexp_extract_all({0}, '(?s)<a\s[^>]*>.*?</a>') AS l FROM pages))"
)

NODE_TAGS = ["a", "li", "h1", "article", "nav", "p", "b", "br", "title", "script"]


@query(
    "html_nodes",
    r"""SELECT page_id, tag, CAST(len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
            '<' || tag || '[ >]')) AS BIGINT) AS n
        FROM pages, (SELECT unnest(['"""
    + "','".join(NODE_TAGS)
    + r"""']) AS tag) WHERE regexp_matches(html, '<' || tag || '[ >]')""",
)
def html_nodes(spark, sf):
    nodes = E.extract_nodes(table(spark, sf, "pages", spread="page_id"), tags=NODE_TAGS)
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "node_texts",
    "SELECT page_id, CAST(pos AS BIGINT) AS k, "
    + PLAIN.format("a")
    + """ AS text, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM """
    + LINKS.format("html"),
)
def node_texts(spark, sf):
    links = E.extract_nodes(table(spark, sf, "pages", spread="page_id"), tags=["a"])
    k = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    return links.select("page_id", k.cast("long").alias("k"), X.strip("text").alias("text"), "href")


HEADING = r"""
WITH h AS (SELECT page_id, url, """ + PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + r""" AS t FROM pages),
g AS (SELECT page_id, CASE WHEN url LIKE 'https%' THEN t || '  [S' || page_id || ']' ELSE t END AS h FROM h)
"""


@query(
    "heading_split",
    HEADING
    + r"""SELECT page_id, CASE WHEN regexp_matches(h, '(.+?)\s*\[([A-Za-z0-9]+)\]')
            THEN regexp_replace(regexp_extract(h, '(.+?)\s*\[([A-Za-z0-9]+)\]', 1), """
    + STRIP
    + r""") ELSE h END AS title, regexp_extract(h, '(.+?)\s*\[([A-Za-z0-9]+)\]', 2) AS session_id FROM g""",
)
def heading_split(spark, sf):
    pages = table(spark, sf, "pages")
    title = E.tag_text(F.col("html"), "h1")
    coded = F.when(F.col("url").startswith("https"), F.concat(title, F.lit("  [S"), "page_id", F.lit("]"))).otherwise(title)
    heads = pages.select("page_id", coded.alias("heading"))
    return E.extract_fields(heads, E.heading_fields(F.col("heading"))).drop("heading")


def _coded_pages(spark, sf):
    tail = F.when(F.col("url").startswith("https"), "A]</a>").otherwise("]</a>")
    code = F.concat(F.lit(" [S"), (F.col("page_id") % 10000 + 10000).cast("string"), tail)
    return table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("</a>"), code).alias("html"))


def _coded_sql(pattern):
    html = "replace(html, '</a>', ' [S' || (page_id % 10000 + 10000) || CASE WHEN url LIKE 'https%' THEN 'A]</a>' ELSE ']</a>' END)"
    return (
        "WITH t AS (SELECT page_id, pos, regexp_extract(a, 'href=\"([^\"]*)\"', 1) AS url, "
        + PLAIN.format("a")
        + " AS t FROM "
        + LINKS.format(html)
        + f""") SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(t, '\\[({pattern})\\]', 1) AS session_id, url,
          regexp_replace(regexp_replace(t, '\\[{pattern}\\]', ''), {STRIP}) AS title
          FROM t WHERE regexp_matches(t, '\\[{pattern}\\]')"""
    )


@query("coded_links", _coded_sql("[A-Z]{1,6}\\d{4,5}[A-Z]?"))
def coded_links(spark, sf):
    return E.coded_links(_coded_pages(spark, sf), "page_id", "html")


@query("coded_links_plain", _coded_sql("[A-Z]{1,6}\\d{4,5}"))
def coded_links_plain(spark, sf):
    return E.coded_links(_coded_pages(spark, sf), "page_id", "html", E.CODE_PLAIN)


@query(
    "link_targets",
    "SELECT page_id, CAST(pos AS INTEGER) AS pos, " + PLAIN.format("a") + " AS text, "
    + """'https://example.org' || regexp_extract(a, 'href="([^"]*)"', 1) AS url FROM """
    + LINKS.format("html")
    + """ WHERE regexp_matches(a, 'href="/[A-Z]')""",
)
def link_targets(spark, sf):
    return E.link_targets(table(spark, sf, "pages"), "page_id", "html", "^/[A-Z]", "https://example.org")


@query(
    "labelled_values",
    r"""WITH t AS (SELECT conv_id, turn, 'Industry: ' || role || chr(10) || text || chr(10) || 'Topic:   t' || turn || ' | x  '
           || chr(10) || 'Intended Audience: all' AS b FROM conversations)
        SELECT conv_id, turn, regexp_replace(regexp_extract(b, 'Industry:\s*([^\n]+)', 1), """ + STRIP + r""") AS industry,
          regexp_replace(regexp_extract(b, 'Topic:\s*([^\n]+)', 1), """ + STRIP + r""") AS topic,
          regexp_extract(b, 'Technical Level:\s*([^\n]+)', 1) AS technical_level,
          regexp_extract(b, 'Intended Audience:\s*([^\n]+)', 1) AS intended_audience,
          regexp_extract(b, 'NVIDIA Technology:\s*([^\n]+)', 1) AS nvidia_technology FROM t""",
)
def labelled_values(spark, sf):
    body = F.concat(
        F.lit("Industry: "), "role", F.lit("\n"), "text", F.lit("\nTopic:   t"), "turn", F.lit(" | x  \nIntended Audience: all")
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"))
    return E.extract_fields(turns, E.labelled_fields(F.col("body"))).drop("body")


@query(
    "badge_fields",
    """SELECT p_partkey, p_type AS session_type,
         CASE WHEN p_size > 40 THEN 'Both' WHEN p_size > 20 THEN 'In-Person' WHEN p_size > 10 THEN 'Virtual' ELSE '' END AS format,
         CASE WHEN p_name LIKE 'old%' THEN 'No' ELSE 'Yes' END AS recording FROM part""",
)
def badge_fields(spark, sf):
    size = F.col("p_size")
    badges = F.filter(
        F.array(
            "p_type",
            F.when(size > 20, "In-Person"),
            F.when((size > 40) | ((size > 10) & (size <= 20)), "Virtual"),
            F.when(F.col("p_name").startswith("old"), "This talk is Not Recorded"),
        ),
        lambda b: b.isNotNull(),
    )
    parts = table(spark, sf, "part").select("p_partkey", badges.alias("badges"))
    return E.extract_fields(parts, E.badge_fields(F.col("badges"))).drop("badges")


@query(
    "speaker_lines",
    """SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN '' WHEN c_nationkey < 15 THEN c_name || '::' || c_mktsegment
         ELSE c_name || ':dr ' || c_nationkey || ':' || c_mktsegment END AS speakers FROM customer""",
)
def speaker_lines(spark, sf):
    nation = F.col("c_nationkey")
    line = (
        F.when(nation < 5, F.col("c_name"))
        .when(nation < 15, F.concat_ws(" | ", "c_name", "c_mktsegment"))
        .otherwise(F.concat(F.lit("  "), "c_name", F.lit(" |  dr "), "c_nationkey", F.lit(" | "), "c_mktsegment"))
    )
    people = table(spark, sf, "customer").select("c_custkey", L.speaker_structs(F.array(line)).alias("people"))
    shown = F.transform("people", lambda p: F.concat_ws(":", p["name"], p["title"], p["company"]))
    return people.select("c_custkey", F.array_join(shown, ";").alias("speakers"))


ITEMS = PLAIN.format("x")


@query(
    "takeaways",
    r"""WITH t AS (SELECT page_id, url, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS l FROM pages)
        SELECT page_id, array_to_string(CASE WHEN url LIKE 'https%' THEN [""" + ITEMS + r""" for x in l]
           ELSE ['• page ' || page_id, 'point two'] END, '; ') AS takeaways FROM t""",
)
def takeaways(spark, sf):
    found = F.regexp_extract_all("html", F.lit("(?s)<li>(.*?)</li>"), F.lit(1))
    items = F.when(F.col("url").startswith("https"), F.transform(found, E.plain_text)).otherwise(
        F.array().cast("array<string>")
    )
    block = F.concat(
        F.lit("Intro\nKey Takeaways:\n• page "), "page_id", F.lit("\n- point two\nRegister now\nAdd to Schedule\nmore")
    )
    pages = table(spark, sf, "pages").select("page_id", items.alias("items"), block.alias("text"))
    out = E.takeaways(F.col("items"), F.col("text"))
    return pages.select("page_id", F.array_join(out, "; ").alias("takeaways"))


@query(
    "marker_slice",
    r"""WITH t AS (SELECT doc_id, instr(text, ' of ') AS i, regexp_replace(substr(text, instr(text, ' of ') + 4), """ + STRIP + r""") AS r
          FROM documents),
        c AS (SELECT *, least(CASE WHEN instr(r, ' the ') > 1 THEN instr(r, ' the ') END,
                              CASE WHEN instr(r, ' and ') > 1 THEN instr(r, ' and ') END) AS e FROM t)
        SELECT doc_id, CASE WHEN i = 0 THEN '' ELSE regexp_replace(CASE WHEN e IS NULL THEN r ELSE substr(r, 1, e - 1) END, """
    + STRIP + r""") END AS part FROM c""",
)
def marker_slice(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", X.slice_after(F.col("text"), " of ", [" the ", " and "]).alias("part"))


@query(
    "schedule_line",
    r"""WITH e AS (SELECT event_id, event_type, strftime(ts, '%A') || ', March ' || day(ts) AS d,
              hour(ts) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') || ' a.m. - 1:00 p.m. PDT' AS t FROM events)
        SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE d END AS date, CASE WHEN event_type = 'error' THEN '' ELSE t END AS time,
          CASE WHEN event_type IN ('error', 'view') THEN '' ELSE 'Hall ' || event_type END AS location FROM e""",
)
def schedule_line(spark, sf):
    ts, kind = F.col("ts"), F.col("event_type")
    day = F.concat(F.date_format(ts, "EEEE"), F.lit(", March "), F.dayofmonth(ts))
    clock = F.concat(F.hour(ts).cast("string"), F.lit(":"), F.date_format(ts, "mm"), F.lit(" a.m. - 1:00 p.m. PDT"))
    text = F.concat(
        F.lit("Home\n\n"),
        F.when(kind == "error", F.lit("no schedule")).otherwise(F.concat(day, F.lit("  |  "), clock)),
        F.when(kind == "view", "\n  Explore More").otherwise(F.concat(F.lit("\n  Hall "), kind)),
        F.lit("\nEnd"),
    )
    found = table(spark, sf, "events").select("event_id", S.schedule_line(X.lines(text)).alias("s"))
    return found.select("event_id", "s.date", "s.time", "s.location")


@query(
    "carry_forward",
    """SELECT event_id, user_id,
         last_value(CASE WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d') END IGNORE NULLS) OVER w AS day,
         last_value(CASE WHEN event_type IN ('view', 'click') THEN event_type || event_id END IGNORE NULLS) OVER w AS slot
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def carry_forward_query(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.when(kind == "signup", F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.when(kind.isin("view", "click"), F.concat("event_type", "event_id")).alias("slot"),
    )
    return carry_forward(rows, ["user_id"], ["event_id"], ["day", "slot"], F.floor(F.col("event_id") / 100_000))


@query(
    "event_types",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'Expo Talk' WHEN 'click' THEN 'Affinity Event' WHEN 'error' THEN 'Event'
         WHEN 'signup' THEN 'Signup Desk' ELSE 'Purchase' END AS session_type FROM events""",
)
def event_types(spark, sf):
    kind = F.col("event_type")
    classes = F.filter(
        F.array(
            F.lit("eventsession"),
            F.lit("pad"),
            F.concat(F.lit("room-"), "user_id"),
            F.when(kind == "signup", "signup-desk").when(kind == "view", "expo-talk").when(kind != "error", kind),
        ),
        lambda c: c.isNotNull(),
    )
    header = F.when(kind == "click", " Affinity Event: ").otherwise("")
    return table(spark, sf, "events").select("event_id", L.class_type(classes, header).alias("session_type"))


@query(
    "block_items",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'Oral' WHEN 'click' THEN 'Poster' WHEN 'signup' THEN 'Poster' ELSE 'Oral' END AS session_type,
         CASE WHEN event_type = 'error' THEN '10:30' WHEN event_type = 'signup' THEN '11:00' ELSE '9:00 AM' END AS time,
         CASE WHEN event_type IN ('error', 'signup') THEN '2:00' ELSE '' END AS end_time FROM events""",
)
def block_items(spark, sf):
    kind = F.col("event_type")
    none = F.array().cast("array<string>")
    own = F.when(kind == "view", F.array(F.lit("content"), F.lit("oral"))).otherwise(none)
    head = F.when(kind.isin("click", "signup"), F.array(F.lit("subevent-header"), F.lit("poster"))).otherwise(none)
    text = F.when(kind == "error", F.concat(F.lit("[10:30] item "), "event_id")).otherwise(F.col("props"))
    header = F.when(kind.isin("error", "signup"), "Posters 11:00-2:00")
    start, end = C.item_times(text, header, F.lit("9:00 AM"))
    return table(spark, sf, "events").select(
        "event_id",
        C.item_type(own, head, F.lit("x oral-session")).alias("session_type"),
        start.alias("time"),
        end.alias("end_time"),
    )


def _calendar_pages(spark, sf):
    """One small programme page per event: a timed event, a listed item, an exhibitor talk."""
    kind = F.col("event_type")
    timed = F.when(kind == "view", "").otherwise('<div class="time">9:00 AM</div>')
    html = F.concat(
        F.lit('<html><body><div class="container2 day-'), F.dayofmonth("ts"), F.lit('"><div class="hdrbox"> '),
        F.date_format("ts", "yyyy-MM-dd"), F.lit(' </div><div class="timebox"><div class="time">8:00 AM</div></div><div class="timebox">'),
        timed, F.lit('<div class="eventsession pad room-hall-1 '), kind, F.lit('-talk"><div class="title-style"><a href="/e/'),
        "event_id", F.lit('">'), "props", F.lit('</a></div><span class="end-time">(ends 11:00 AM)</span></div>'),
        F.lit('<div class="poster-session"><div class="eventblock"><div class="subevent-header poster">P 11:00-2:00</div>'
              '<div class="content oral">[10:30] <a href="/o/'), "event_id", F.lit('">Talk '), "event_id",
        F.lit('</a></div><div class="content poster">Poster '), "user_id",
        F.lit('</div></div></div><div class="exhibitor-spot-talks"><div class="content talk"><a href="/x/'), "event_id",
        F.lit('">Booth '), "user_id", F.lit('</a></div><div class="content talk">no link</div></div></div></div></body></html>'),
    )
    return table(spark, sf, "events", spread="event_id").select(F.col("event_id").alias("page_id"), html.alias("html"))


CALENDAR = """
WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_type = 'view' THEN '8:00 AM' ELSE '9:00 AM' END AS time FROM events)
SELECT event_id AS page_id, props AS title, date, time, '11:00 AM' AS end_time, '' AS speaker,
  upper(event_type[1]) || event_type[2:] || ' Talk' AS session_type, 'https://example.org/e/' || event_id AS url, '' AS abstract FROM e
UNION ALL SELECT event_id, 'Talk ' || event_id, date, '10:30', '2:00', '', 'Oral', 'https://example.org/o/' || event_id, '' FROM e
UNION ALL SELECT event_id, 'Poster ' || user_id, date, '11:00', '2:00', '', 'Poster', '', '' FROM e
"""
BOOTHS = "SELECT event_id, 'Booth ' || user_id, date, time, '', '', 'Exhibitor Talk', 'https://example.org/x/' || event_id, '' FROM e"


@query("calendar_events", CALENDAR + " UNION ALL " + BOOTHS)
def calendar_events(spark, sf):
    nodes = E.extract_nodes(_calendar_pages(spark, sf), containers=C.EVENTS, groups=C.EVENT_ROWS)
    return C.calendar_events(nodes, "https://example.org").drop("pos")


@query(
    "exhibitor_talks",
    "SELECT page_id, " + PLAIN.format("a") + """ AS title, 'https://example.org' || regexp_extract(a, 'href="([^"]*)"', 1) AS url,
       'Exhibitor Talk' AS session_type FROM """ + LINKS.format("html"),
)
def exhibitor_talks(spark, sf):
    """The link lists of the pages, read as exhibitor items."""
    html = F.replace(F.replace("html", F.lit("<li>"), F.lit('<div class="content talk">')), F.lit("</li>"), F.lit("</div>"))
    booth = F.concat(
        F.lit('<div class="container2 day-1"><div class="timebox"><div class="exhibitor-spot-talks">'),
        F.regexp_extract(html, "(?s)<ul>(.*?)</ul>", 1),
        F.lit("</div></div></div>"),
    )
    nodes = E.extract_nodes(table(spark, sf, "pages", spread="page_id").select("page_id", booth.alias("html")), containers=C.EVENTS, groups=C.EVENT_ROWS)
    return C.calendar_events(nodes, "https://example.org").select("page_id", "title", "url", "session_type")


@query(
    "table_rows",
    """SELECT o_orderkey AS page_id, 'u' || o_custkey AS data_event_modal, o_orderpriority AS title, '09:00' AS start_time,
         '90m' AS duration, 'Talk' AS event_type, o_orderstatus AS track, 'Ann,' || o_orderstatus || ',/p/' || o_custkey || ';Bob,,/p/2' AS authors
       FROM orders WHERE o_orderstatus <> 'P'""",
)
def table_rows(spark, sf):
    """A programme page per order, its row listed twice; pages of another day give no row."""
    row = F.concat(
        F.lit('<tr data-slot-id="1"><td><div class="start-time">09:00</div><span class="text-muted"><strong>90m</strong></span>'
              '<div class="event-type">Talk</div><a data-event-modal="u'), "o_custkey", F.lit('" href="#">'), "o_orderpriority",
        F.lit('</a><div class="prog-track">'), "o_orderstatus", F.lit('</div><div class="performers"><a class="navigate" href="/p/'),
        "o_custkey", F.lit('">Ann</a> <span class="prog-aff">'), "o_orderstatus",
        F.lit('</span><a class="navigate" href="/p/2">Bob</a><i>x</i></div></td></tr>'),
    )
    day = F.when(F.col("o_orderstatus") == "P", "Mon 1").otherwise("Sun 12 Apr")
    html = F.concat(F.lit('<div class="day-wrapper"><h4 class="day-header"> '), day, F.lit("</h4><table>"), row, row, F.lit("</table></div>"))
    pages = table(spark, sf, "orders", spread="o_orderkey").select(F.col("o_orderkey").alias("page_id"), html.alias("html"))
    rows = C.table_rows(E.extract_nodes(pages, containers=C.ROWS, groups=C.TABLE_ROWS), "Sun 12")
    people = F.transform("authors", lambda a: F.concat_ws(",", a["name"], a["affiliation"], a["profile_url"]))
    return rows.withColumn("authors", F.array_join(people, ";"))


@query(
    "detail_paragraphs",
    r"""WITH p AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (
          SELECT page_id, regexp_extract_all(html, '(?s)<p>([^<]*)</p>', 1) AS l FROM pages)),
        q AS (SELECT page_id, pos, """ + PLAIN.format("x") + r""" AS t FROM p)
        SELECT pages.page_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY pos) FILTER (t <> ''), '') AS abstract
        FROM pages LEFT JOIN q ON q.page_id = pages.page_id GROUP BY 1""",
)
def detail_paragraphs(spark, sf):
    found = F.regexp_extract_all("html", F.lit("(?s)<p>([^<]*)</p>"), F.lit(1))
    kept = F.filter(F.transform(found, E.plain_text), lambda t: t != "")
    return table(spark, sf, "pages").select("page_id", F.array_join(kept, "\n\n").alias("abstract"))


@query(
    "detail_rows",
    """SELECT c_custkey AS page_id, c_mktsegment AS track_full_name, 'Sun 12 Apr 2026' AS datetime_str, 'Session ' || c_nationkey AS session_name,
         'Room ' || c_nationkey AS room, c_name || chr(10) || chr(10) || 'Second' AS abstract,
         c_name || ',' || c_mktsegment || ',N' || c_nationkey || ',/p/' || c_custkey AS authors FROM customer""",
)
def detail_rows(spark, sf):
    html = F.concat(
        F.lit('<div class="modal-header"><div class="text-muted"> '), "c_mktsegment",
        F.lit('</div><strong>Sun 12 Apr 2026</strong><a class="navigate" href="/s">Session '), "c_nationkey",
        F.lit('</a><a class="room-link" href="/r">Room '), "c_nationkey",
        F.lit('</a></div><div class="event-description"><p>'), "c_name", F.lit("</p><p>  </p><p>Second</p></div>"),
        F.lit('<a href="/p/'), "c_custkey", F.lit('"><div class="media"><h5 class="media-heading">'), "c_name",
        F.lit('</h5><span class="text-black">'), "c_mktsegment", F.lit("</span><small>N"), "c_nationkey", F.lit("</small></div></a>"),
    )
    pages = table(spark, sf, "customer", spread="c_custkey").select(F.col("c_custkey").alias("page_id"), html.alias("html"))
    rows = C.detail_rows(E.extract_nodes(pages, containers=C.DETAILS, groups=C.DETAIL_ROWS))
    people = F.transform("authors", lambda a: F.concat_ws(",", a["name"], a["affiliation"], a["country"], a["profile_url"]))
    return rows.withColumn("authors", F.array_join(people, ";"))


@query(
    "calendar_entry_fields",
    r"""SELECT page_id, split_part(url, '#', 1) AS url, regexp_extract(url, '/([a-z-]+)/(\d+)', 1) AS kind,
          regexp_extract(url, '/([a-z-]+)/(\d+)', 2) AS id, 'Grand ' || upper(k[1]) || k[2:] || ' ' || page_id AS room, '11:00 AM' AS end_raw
        FROM (SELECT *, regexp_extract(url, '/([a-z-]+)/(\d+)', 1) AS k FROM pages)""",
)
def calendar_entry_fields(spark, sf):
    kind = F.regexp_extract("url", r"/([a-z-]+)/(\d+)", 1)
    classes = F.array(F.lit("pad"), F.concat(F.lit("room-grand-"), kind, F.lit("-"), "page_id"))
    pages = table(spark, sf, "pages")
    return pages.select("page_id", *[
        c.alias(n) for n, c in E.entry_fields(F.col("url"), classes, F.lit("(ends 11:00 AM)"), "/").items()
    ])


@query(
    "calendar_entries",
    """SELECT event_id AS page_id, event_type AS kind, CAST(event_id AS VARCHAR) AS id, 'https://e.org/v/' || event_type || '/' || event_id AS url,
         props AS title, '9 a.m.' AS start_raw, '11:00 AM' AS end_raw,
         CASE WHEN event_type = 'view' THEN 'Keynote Talk' ELSE 'Session' END AS kind_label, 'Ann' AS speaker_on_calendar,
         'Hall ' || user_id AS room, 'Paper ' || event_id || ' /p/' || event_id AS papers FROM events""",
)
def calendar_entries(spark, sf):
    html = F.concat(
        F.lit('<div class="gcol days"><div class="timebox"><div class="time">9 a.m.</div><div class="eventsession pad room-hall-'),
        "user_id", F.lit('"><div class="hdr-style">'), F.when(F.col("event_type") == "view", "Keynote Talk:").otherwise(""),
        F.lit('</div><div class="title-style"><a href="https://e.org/v/'), "event_type", F.lit("/"), "event_id", F.lit('#x">'), "props",
        F.lit('</a></div><div class="speaker-style">Ann</div><span class="end-time">(ends 11:00 AM)</span>'
              '<div class="content"><a href="/p/'), "event_id", F.lit('#y">Paper '), "event_id", F.lit("</a></div></div></div></div>"),
    )
    pages = table(spark, sf, "events", spread="event_id").select(F.col("event_id").alias("page_id"), html.alias("html"))
    rows = C.calendar_entries(E.extract_nodes(pages, containers=C.ENTRIES, groups=C.ENTRY_ROWS), "/v/").drop("pos", "day_no")
    return rows.withColumn("papers", F.array_join(F.transform("papers", lambda p: F.concat_ws(" ", p["title"], p["url"])), ";"))


@query(
    "talk_fields",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE 'T' || doc_id END AS detail_title, 'Mon, May 18, 2026' AS date_line,
         'Hall ' || lang AS room, CASE WHEN lang = 'en' THEN '' ELSE 'Dr ' || source END AS speaker FROM documents""",
)
def talk_fields(spark, sf):
    title = F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("T"), "doc_id"))
    texts = F.concat(
        F.array(F.lit("Menu"), F.lit("Invited  Talk"), F.lit("Mon, May 18, 2026"), F.concat(F.lit("Hall "), "lang"), title,
                F.concat(F.lit("Dr "), "source")),
        X.lines(F.col("text")),
    )
    docs = table(spark, sf, "documents").select("doc_id", "source", title.alias("t"), texts.alias("texts"))
    fields = E.talk_fields(F.col("texts"), F.col("t"), {"title": F.col("source")})
    return E.extract_fields(docs, fields).drop("texts", "t", "source")


@query(
    "session_cards",
    """SELECT o_orderkey AS page_id, 'Paper ' || o_custkey AS title, '/p/' || o_orderkey AS url, 'A * B ' || o_orderstatus AS authors,
         o_orderpriority AS abstract FROM orders""",
)
def session_cards(spark, sf):
    html = F.concat(
        F.lit('<main><div class="track-schedule-card"><div><h5><a href="/p/'), "o_orderkey", F.lit('#abs">Paper\n '), "o_custkey",
        F.lit('</a></h5><p class="text-muted">A * B '), "o_orderstatus", F.lit('</p></div><div class="abstract"> '), "o_orderpriority",
        F.lit('</div></div><div class="track-schedule-card"><p>no title</p></div></main>'),
    )
    pages = table(spark, sf, "orders", spread="o_orderkey").select(F.col("o_orderkey").alias("page_id"), html.alias("html"))
    return E.session_cards(E.extract_nodes(pages, containers=E.CARDS, groups=E.CARD_ROWS)).drop("pos")


@query(
    "session_time_line",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE 'Tue ' || day(ts) || ' May 1 p.m. PDT — 2:30 p.m. PDT' END AS time_line FROM events""",
)
def session_time_line(spark, sf):
    line = F.when(F.col("event_type") == "error", F.lit("Tue 19 May all day")).otherwise(
        F.concat(F.lit("Tue "), F.dayofmonth("ts"), F.lit(" May 1 p.m.  PDT\n — 2:30 p.m. PDT"))
    )
    texts = F.array(F.col("props"), F.regexp_replace(line, r"\s+", " "), F.lit("Wed x"))
    return table(spark, sf, "events").select("event_id", E.session_fields(texts)["time_line"].alias("time_line"))


@query(
    "oral_fields",
    r"""SELECT doc_id, source AS title, 'Ann · Bob' AS authors, 'Oral ' || lang AS session_name, 'https://e.org/session/' || doc_id AS session_url,
          CASE WHEN lang = 'en' THEN 'https://openreview.net/forum?id=' || doc_id ELSE '' END AS openreview_url,
          '/attachment/' || doc_id AS slides_url, 'Apr 24 2026' AS date, '3:30 p.m.' AS start_time, '5 p.m.' AS end_time,
          regexp_replace(text, """ + STRIP + r""") AS abstract FROM documents""",
)
def oral_fields(spark, sf):
    text = F.concat(
        F.lit("Oral\nApr 24 2026 3:30 p.m. PDT — 5 p.m. PDT\nAbstract:\n"), "text", F.lit("\nChat\nmore\nDirectory")
    )
    link = lambda href, label: F.struct(href.alias("href"), label.alias("text"))
    links = F.array(
        link(F.lit("/home"), F.lit("Slides")),
        link(F.concat(F.lit("/session/"), "doc_id"), F.concat(F.lit(" Oral "), "lang")),
        link(F.when(F.col("lang") == "en", F.concat(F.lit("https://openreview.net/forum?id="), "doc_id")).otherwise("/x"), F.lit("paper")),
        link(F.concat(F.lit("/attachment/"), "doc_id"), F.lit("Slides")),
    )
    docs = table(spark, sf, "documents").select("doc_id", "source", text.alias("body"), links.alias("links"))
    people = F.array(F.lit("Menu"), F.lit("Ann · Bob"))
    fields = E.oral_fields(F.col("source"), people, F.col("body"), F.col("links"), "https://e.org")
    return docs.select("doc_id", *[c.alias(n) for n, c in fields.items()])


@query(
    "workshop_fields",
    r"""SELECT doc_id, source AS title, 'Sun, Apr 26, 2026' AS date, '5:00 AM' AS start_time, '1:00 PM' AS end_time, 'PDT' AS timezone,
          CASE WHEN lang = 'en' THEN 'Ann · Bob' ELSE 'Cy · Di · Ed' END AS organizers,
          regexp_replace(text, """ + STRIP + r""") AS abstract, CASE WHEN lang = 'de' THEN '' ELSE '/proj/' || doc_id END AS project_url FROM documents""",
)
def workshop_fields(spark, sf):
    text = F.concat(
        F.lit("Workshop\nSun, Apr 26, 2026 • 5:00 AM – 1:00 PM PDT\nAnn · Bob\n  Cy · Di · Ed \nAbstract\n"), "text", F.lit("\nLog in\nmore")
    )
    label = F.when(F.col("lang") == "de", "Project").otherwise("Project Page")
    links = F.array(F.struct(F.concat(F.lit("/proj/"), "doc_id").alias("href"), label.alias("text")))
    people = F.when(F.col("lang") == "en", F.array(F.lit("Ann · Bob"))).otherwise(F.array(F.lit("none")))
    docs = table(spark, sf, "documents").select("doc_id", "source", text.alias("body"), links.alias("links"), people.alias("people"))
    fields = E.workshop_fields(F.col("source"), F.col("people"), F.col("body"), F.col("links"))
    return docs.select("doc_id", *[c.alias(n) for n, c in fields.items()])


@query(
    "first_url",
    """SELECT page_id, CASE WHEN url LIKE 'http://%' AND url NOT LIKE '%#%' AND url LIKE '%?%' THEN '' ELSE url END AS company_url FROM pages""",
)
def first_url(spark, sf):
    url = F.col("url")
    text = (
        F.when(url.startswith("https"), F.concat(F.lit("- /url: http://other.org\n- link \""), url, F.lit('" [ref=e1]:\n')))
        .when(url.contains("?") & ~url.contains("#"), F.lit("- link \"Home\" [ref=e2]:"))
        .otherwise(F.concat(F.lit("- text\n  - /url: "), url, F.lit("\n- /url: http://later.org")))
    )
    return table(spark, sf, "pages").select("page_id", U.first_url(text).alias("company_url"))


@query(
    "all_urls",
    r"""SELECT page_id, array_to_string(regexp_extract_all(url || ' and ' || html || chr(10) || 'http://www.a-b.co.uk/x?y=1 ftp://no',
          'https?://(?:www\.)?(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?:/[^\s]*)?'), ' ') AS urls FROM pages""",
)
def all_urls(spark, sf):
    text = F.concat("url", F.lit(" and "), "html", F.lit("\nhttp://www.a-b.co.uk/x?y=1 ftp://no"))
    return table(spark, sf, "pages").select("page_id", F.array_join(U.all_urls(text), " ").alias("urls"))


@query(
    "name_refs",
    "WITH t AS (SELECT page_id, pos, " + PLAIN.format("a") + " AS name FROM " + LINKS.format("html") + ")"
    + " SELECT name, arg_max('p' || page_id || 'e' || pos, page_id * 100000 + pos) AS ref FROM t WHERE name <> '' AND name NOT LIKE '%\"%' GROUP BY 1",
)
def name_refs(spark, sf):
    links = E.anchors(F.col("html"))
    listed = F.transform(
        links,
        lambda a, i: F.concat(F.lit('- link "'), a["text"], F.lit('" [ref=p'), F.col("page_id"), F.lit("e"), i, F.lit("]")),
    )
    snapshots = table(spark, sf, "pages").select("page_id", F.array_join(listed, "\n").alias("snapshot"))
    return E.name_refs(snapshots, "page_id", "snapshot")


@query(
    "facet_labels",
    r"""SELECT DISTINCT regexp_replace(x, """ + STRIP + r""") AS label FROM (
          SELECT unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS x FROM pages) WHERE regexp_replace(x, """ + STRIP + r""") <> ''""",
)
def facet_labels(spark, sf):
    html = F.replace("html", F.lit('<a href="/'), F.lit('<label for="keytheme-desktop-'))
    return E.facet_labels(table(spark, sf, "pages").select(html.alias("html")), "html", "keytheme-desktop-")


@query(
    "session_details",
    r"""SELECT doc_id AS page_id, 'T ' || source AS title, 'S' || doc_id AS session_id, 'Panel' AS session_type,
          CASE WHEN lang = 'en' THEN 'Both' ELSE 'Virtual' END AS format, CASE WHEN lang = 'de' THEN 'No' ELSE 'Yes' END AS recording,
          regexp_replace(text, """ + STRIP + r""") AS abstract, source AS industry, lang AS topic, '' AS technical_level, 'all' AS intended_audience,
          '' AS nvidia_technology, CASE WHEN lang = 'fr' THEN 'first;second' ELSE 'point ' || doc_id || ';two' END AS key_takeaways,
          'Ann:CTO:' || source AS speakers FROM documents""",
)
def session_details(spark, sf):
    badge = F.when(F.col("lang") == "en", '<i class="badge">In-Person</i>').when(F.col("lang") == "de", '<i class="badge">Not Recorded</i>').otherwise("")
    points = F.when(F.col("lang") == "fr", F.lit("<p>Key Takeaways:</p><p>first</p><p>• second</p><p>Register</p>")).otherwise(
        F.concat(F.lit("<div><b>Key Takeaways:</b><ul><li>point "), "doc_id", F.lit("</li><li> two </li></ul></div><ul><li>other</li></ul>"))
    )
    html = F.concat(
        F.lit("<html><head><title>x</title></head><body><h1>T "), "source", F.lit(" [S"), "doc_id", F.lit(']</h1><i class="badge">Panel</i><i class="badge">Virtual</i>'),
        badge, F.lit('<div class="abstract"><p>'), "text", F.lit('</p></div><span class="p--medium">Ann | CTO | '), "source",
        F.lit('</span><span class="p--medium">no bar</span><p>Industry: '), "source", F.lit("</p><p>Topic: "), "lang",
        F.lit("</p><div>Intended Audience: all</div>"), points, F.lit("</body></html>"),
    )
    docs = table(spark, sf, "documents", spread="doc_id").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    out = E.session_details(docs)
    people = F.transform("speakers", lambda p: F.concat_ws(":", p["name"], p["title"], p["company"]))
    return out.withColumns({"key_takeaways": F.array_join("key_takeaways", ";"), "speakers": F.array_join(people, ";")})


@query(
    "oral_pages",
    r"""SELECT conv_id * 1000 + turn AS page_id, 'Talk ' || role AS title, 'Ann · Bob' AS authors, 'Oral 1' AS session_name,
          'https://e.org/session/' || conv_id AS session_url, '' AS openreview_url, '/slides/' || turn AS slides_url, 'Apr 24 2026' AS date,
          '3:30 p.m.' AS start_time, '5 p.m.' AS end_time,
          array_to_string(list_filter([regexp_replace(x, """ + STRIP + r""") for x in string_split(text, chr(10))], lambda y: y <> ''), chr(10)) AS abstract
        FROM conversations""",
)
def oral_pages(spark, sf):
    html = F.concat(
        F.lit("<h2>Main Navigation</h2><h2>Talk "), "role", F.lit('</h2><h3>Oral</h3><h3>Ann · Bob</h3><a href="/session/'), "conv_id",
        F.lit('">Oral 1</a><a href="/slides/'), "turn", F.lit('">Slides</a><div>Apr 24 2026 3:30 p.m. PDT - 5 p.m. PDT</div><div>Abstract:</div><p>'),
        "text", F.lit("</p><div>Chat</div><p>more</p>"),
    )
    pages = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), html.alias("html"))
    return pages.select("page_id", *[c.alias(n) for n, c in E.oral_page(F.col("html"), "https://e.org").items()])


@query(
    "workshop_pages",
    r"""SELECT conv_id * 1000 + turn AS page_id, 'W ' || role AS title, 'Sun, Apr 26, 2026' AS date, '5:00 AM' AS start_time, '1:00 PM' AS end_time,
          'PDT' AS timezone, 'Cy · Di · Ed' AS organizers, '/proj/' || turn AS project_url,
          array_to_string(list_filter([regexp_replace(x, """ + STRIP + r""") for x in string_split(text, chr(10))], lambda y: y <> ''), chr(10)) AS abstract
        FROM conversations""",
)
def workshop_pages(spark, sf):
    html = F.concat(
        F.lit("<h1>W "), "role", F.lit('</h1><p>Sun, Apr 26, 2026 · 5:00 AM - 1:00 PM PDT</p><p>Cy · Di · Ed</p><a href="/proj/'), "turn",
        F.lit('">Project Page</a><h3>Abstract</h3><p>'), "text", F.lit("</p><p>Log in</p>"),
    )
    pages = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), html.alias("html"))
    return pages.select("page_id", *[c.alias(n) for n, c in E.workshop_page(F.col("html")).items()])


@query(
    "detail_pages",
    """SELECT o_orderkey AS page_id, CASE WHEN o_orderstatus = 'P' THEN 'invited-talk' ELSE 'session' END AS kind,
         CASE WHEN o_orderstatus = 'P' THEN 'Talk ' || o_orderpriority ELSE 'Group ' || o_orderpriority END AS title,
         'Hall ' || o_custkey AS room, CASE WHEN o_orderstatus = 'P' THEN 'Mon, May 18, 2026' ELSE '' END AS date_line,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Tue 19 May 1 p.m. PDT — 2:30 p.m. PDT' END AS time_line,
         CASE WHEN o_orderstatus = 'P' THEN 'Dr ' || o_custkey ELSE '' END AS speaker,
         CASE WHEN o_orderstatus = 'P' THEN 'About ' || o_orderkey ELSE '' END AS abstract,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'Paper ' || o_orderkey || ' /p/' || o_orderkey || ' A * B text' END AS papers FROM orders""",
)
def detail_pages(spark, sf):
    talk = F.concat(
        F.lit("<main><div>INVITED TALK</div><div>Mon, May 18, 2026</div><span>Hall "), "o_custkey", F.lit("</span><h1>Talk "), "o_orderpriority",
        F.lit("</h1><p>Dr "), "o_custkey", F.lit("</p><h3> Abstract </h3><div><p>About "), "o_orderkey", F.lit("</p></div></main>"),
    )
    group = F.concat(
        F.lit("<main><h2>Group "), "o_orderpriority", F.lit("</h2><h5>Hall "), "o_custkey",
        F.lit('</h5><p>Tue 19 May 1 p.m. PDT\n — 2:30 p.m. PDT</p><div class="track-schedule-card"><div><h5><a href="/p/'), "o_orderkey",
        F.lit('#x">Paper '), "o_orderkey", F.lit('</a></h5><p>A * B</p></div><div class="abstract">text</div></div></main>'),
    )
    is_talk = F.col("o_orderstatus") == "P"
    pages = table(spark, sf, "orders", spread="o_orderkey").select(
        F.col("o_orderkey").alias("page_id"),
        F.when(is_talk, "invited-talk").otherwise("session").alias("kind"),
        F.when(is_talk, talk).otherwise(group).alias("html"),
    )
    out = E.detail_pages(pages).select("page_id", "kind", "detail.*")
    shown = F.transform("papers", lambda p: F.concat_ws(" ", p["title"], p["url"], p["authors"], p["abstract"]))
    return out.withColumn("papers", F.array_join(shown, ";"))
