"""Page jobs find what they want while a page is parsed: nothing is dealt out or sorted for it."""

import random

from recordloom.operators import calendar as C
from recordloom.operators import extract as E
from recordloom.plans import QUERIES
from tests.conftest import FOLDER


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_calendar_events_needs_no_window(spark):
    text = plan(spark, "calendar_events")
    assert "Window" not in text and "Sort" not in text and "hashpartitioning(page_id" not in text


def test_plain_markup_is_read_as_the_parser_reads_it():
    rules, draw = E._Rules(C.EVENTS), random.Random(3)
    parts = ['<div class="timebox x">', "</div>", "<p>", "</P>", "<BR>", "<br/>", '<a HREF="/x">', "</a>", "t ", "&amp; x", "&lt", "x > y", "<!-- c -->",
             "<i x>", '<b a="1" a="2">', "<script>", "</script>", "<title>", '<a href="/q&amp;r">', "<u id='1'>", "</u >", "< x", "<x-y>", "&", '"']
    for _ in range(3000):
        html = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        one, other = E._Outline(rules), E._Outline(rules)
        other._read = lambda text, other=other: (other.feed(text), other.close())
        assert one.outline(html) == other.outline(html), html


def test_groups_leave_the_rows_of_a_job(spark):
    page = '<table><tr data-slot-id="1"><td><div class="day-wrapper"><h4 class="day-header">Sun 12</h4><tr data-slot-id="2"><a data-event-modal="u"><b>x</b></a></tr></div></td></tr></table>'
    pages = spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id long, html string")
    rows = E.extract_nodes(pages, containers=C.ROWS, groups=C.TABLE_ROWS)
    assert rows.count() == 2
    assert C.table_rows(rows, "Sun").collect() == C.table_rows(E.extract_nodes(pages, containers=C.ROWS), "Sun").collect() != []


def test_table_rows_sorts_only_for_its_distinct_ids(spark):
    text = plan(spark, "table_rows")
    assert "Window" not in text and "collect_list" not in text and text.count("hashpartitioning(page_id") <= 1


def test_calendar_entries_is_map_only(spark):
    text = plan(spark, "calendar_entries")
    assert "Window" not in text and "Aggregate" not in text and "Sort" not in text


def test_detail_pages_joins_nothing(spark):
    text = plan(spark, "detail_pages")
    assert "Join" not in text and "Window" not in text and "Aggregate" not in text
    pages = spark.createDataFrame([("a", "session", ""), ("b", "session", "<p>x</p>"), (None, "invited-talk", "<h1>T</h1><h3>Abstract</h3><p>A</p>")], "page_id string, kind string, html string")
    rows = {r["page_id"]: r["detail"] for r in E.detail_pages(pages).collect()}
    assert rows["a"]["papers"] is None and rows["b"]["papers"] == [] and rows[None]["abstract"] == "A"


def test_session_cards_and_detail_rows_are_map_only(spark):
    for name in ("session_cards", "detail_rows"):
        text = plan(spark, name)
        assert "Window" not in text and "Aggregate" not in text and "Sort" not in text
