"""Golden records, decided differences, and invariants."""

import json

import pytest
from pyspark.sql import functions as F

from recordloom import schemas
from recordloom.functions import lists as L
from recordloom.functions import schedule as S
from recordloom.functions import text as X
from recordloom.functions import urls as U
from recordloom.functions.scores import composite
from recordloom.operators import calendar as C
from recordloom.operators import dedup as D
from recordloom.operators import extract as E
from recordloom.operators import match as M
from recordloom.operators import normalize as N
from recordloom.operators import quality as Q
from recordloom.operators import reconcile as R
from recordloom.sources import files, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


TEXT = """
Title: First Paper
Authors: Ann Lee, Bo Ek
Venue: Conf 2025 Poster
Affinity Score: 0.8047
Link: https://example.org/a.pdf
Keywords: 
BibTeX:
@inproceedings{
lee2025,
Venue: Inside Wins
}
--------------------------------------------------------------------------------

Title: Second
Affinity Score: high
Keywords: x, y
--------------------------------------------------------------------------------
Authors: No Title
--------------------------------------------------------------------------------
"""


def test_text_records(spark, tmp_path):
    (tmp_path / "p.txt").write_text(TEXT)
    got = [r.asDict() for r in files.read_text_records(spark, str(tmp_path / "p.txt")).collect()]
    assert got == [
        {"title": "First Paper", "authors": "Ann Lee, Bo Ek", "venue": "Inside Wins", "affinity_score": 0.8047,
         "link": "https://example.org/a.pdf", "keywords": None, "bibtex": "@inproceedings{\nlee2025,\nVenue: Inside Wins\n}"},
        {"title": "Second", "authors": None, "venue": None, "affinity_score": 0.0, "link": None, "keywords": "x, y", "bibtex": None},
    ]


def test_pretty_envelope_with_optional_fields(spark, tmp_path):
    doc = {"venue": "V", "year": 2026, "workshops": [
        {"number": "1", "sequence": 1, "title": "A", "organizers": [{"name": "n", "affiliation": "a"}], "url": None},
        {"number": "-", "sequence": 2, "title": "B", "organizers": [], "room": "R"}]}
    (tmp_path / "w.json").write_text(json.dumps(doc, indent=1))
    rows = files.read_envelope(spark, str(tmp_path / "w.json"), "workshops", schemas.WORKSHOP, pretty=True).collect()
    assert [(r.venue, r.sequence, r.room, len(r.organizers)) for r in rows] == [("V", 1, None, 1), ("V", 2, "R", 0)]


def test_record_list_labelled_by_file(spark, tmp_path):
    for day, n in (("23", 2), ("24", 1)):
        rows = [{"title": f"t{i}", "url": f"/{day}/{i}", "session_type": "Oral"} for i in range(n)]
        (tmp_path / f"day_4_{day}.json").write_text(json.dumps(rows, indent=2))
    got = files.read_labelled(spark, str(tmp_path), schemas.LISTED_SESSION, r"day_(\d+_\d+)\.json", "day", pretty=True)
    assert sorted((r.day, r.title, r.speakers) for r in got.collect()) == [("4_23", "t0", None), ("4_23", "t1", None), ("4_24", "t0", None)]


def test_nested_map_and_unit_text(spark, tmp_path):
    doc = {"B": {"two ": ["x", "y"], "one": ["z"]}, "A": {"one": ["w"]}}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    rows = files.read_nested_map(spark, str(tmp_path / "m.json"))
    assert [(r.unit, r.category, r.text) for r in rows.collect()] == [
        ("B", "two ", "x"), ("B", "two ", "y"), ("B", "one", "z"), ("A", "one", "w")]
    numbered = rows.withColumn("p", F.col("category_pos") * 1000 + F.col("text_pos"))
    text = {r.unit: r.unit_text for r in D.text_per_unit(numbered, "unit", "p", "category", "text").collect()}
    assert text["B"] == "[two] x\n[two] y\n[one] z"


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes('﻿bu_name,rel\n"A ""q""\nb",0.5\n'.encode())
    rows = files.read_csv(spark, str(tmp_path / "c.csv"), ["bu_name", "rel", "gone"]).collect()
    assert [tuple(r) for r in rows] == [('A "q"\nb', "0.5", "")]


def test_composite_formula(spark):
    parts = {"rel": F.lit(0.9), "tech_overlap": F.lit(0.85), "novelty": F.lit(0.8), "actionability": F.lit(0.75)}
    assert value(spark, composite(parts, F.lit(0.95))) == pytest.approx(0.8360625, abs=1e-12)


PAGE = """
<div class="container2 day-1"><div class="hdrbox">SAT 6 DEC</div>
 <div class="timebox"><div class="time">8 a.m.</div>
  <div class="eventsession pad room-hall-a expo-talk"><div class="hdr-style">Affinity Event:</div>
   <div class="title-style"><a href="/e/1">One &amp; Two</a></div><span class="end-time">(ends 11:00 AM)</span></div>
  <div class="eventsession pad workshop-day"><div class="title-style">No link</div></div>
  <div class="eventsession pad"></div>
 </div>
 <div class="timebox">
  <div class="san-diego-oral-session"><div class="eventblock"><div class="subevent-header poster">Posters 11:00-2:00</div>
   <div class="content oral">[10:30] <a href="/o/1">Oral 1</a></div>
   <div class="content poster">Poster plain</div></div>
   <div class="eventblock"><div class="content poster"><a href="/p/2">P2</a></div></div></div>
  <div class="exhibitor-spot-talks"><div class="content talk"><a href="/x">Booth</a></div><div class="content talk">none</div></div>
 </div></div>
<div class="container2 day-2"><div class="timebox"><div class="eventsession pad"><div class="title-style"><a href="/e/9">Late</a></div></div></div></div>
"""


def test_calendar_page(spark):
    nodes = E.extract_nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string"), containers=C.EVENTS)
    rows = C.calendar_events(nodes, "https://e.org").orderBy("pos").collect()
    assert [(r.title, r.date, r.time, r.end_time, r.session_type, r.url) for r in rows] == [
        ("One & Two", "SAT 6 DEC", "8 a.m.", "11:00 AM", "Affinity Event", "https://e.org/e/1"),
        ("No link", "SAT 6 DEC", "8 a.m.", "", "Workshop Day", ""),
        ("Oral 1", "SAT 6 DEC", "10:30", "2:00", "Oral", "https://e.org/o/1"),
        ("Poster plain", "SAT 6 DEC", "11:00", "2:00", "Poster", ""),
        ("P2", "SAT 6 DEC", "8 a.m.", "", "Poster", "https://e.org/p/2"),
        ("Booth", "SAT 6 DEC", "8 a.m.", "", "Exhibitor Talk", "https://e.org/x"),
        ("Late", "SAT 6 DEC", "8 a.m.", "", "Event", "https://e.org/e/9"),
    ]


def test_calendar_without_inherited_times(spark):
    nodes = E.extract_nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string"), containers=C.EVENTS)
    rows = C.calendar_events(nodes, "", inherit_time=False).collect()
    assert {r.title: r.time for r in rows if r.title in ("One & Two", "Booth", "Late")} == {"One & Two": "8 a.m.", "Booth": "", "Late": ""}


CALENDAR = """<div class="gcol days"><div class="timebox"><div class="time">8:45 a.m.</div>
<div class="eventsession pad room-grand-ballroom-1"><div class="hdr-style">Invited Talk:</div><div class="title-style"><a href="https://e.org/v/invited-talk/7#x">Big “Talk”</a></div></div>
<div class="session pad"><div class="sessiontitle"><a href="https://e.org/v/session/8">Research-Track Oral Presentation: R1: Nets [8:30-10:00]</a></div>
<div class="content"><a href="/v/oral/1">P1</a></div></div><div class="session pad"><div class="sessiontitle"><a href="/other">skip</a></div></div></div></div>"""
TALK = """<main><div>INVITED TALK</div><div>Mon, May 18, 2026 ⋅ 8:45 AM – 9:05 AM PDT</div><div>Hall A</div><h1>Big Talk</h1><p>Dr Who</p><h3>Abstract</h3><div>On <b>x</b></div></main>"""
GROUP = """<main><h2>R1: Nets</h2><h5>Hall B</h5><div>Tue 19 May 1 p.m. PDT — 2:30 p.m. PDT</div>
<div class="track-schedule-card"><div><h5><a href="/v/oral/1#a">P1</a></h5><p class="text-muted">Ann ⋅ Bob ⋅</p></div><div class="abstract">A1</div></div>
<div class="track-schedule-card"><div><h5>P2</h5></div></div></main>"""


def test_pages_to_published_sessions(spark):
    entries = C.calendar_entries(E.extract_nodes(spark.createDataFrame([(1, CALENDAR)], "page_id long, html string"), containers=C.ENTRIES), "/v/")
    details = spark.createDataFrame([(7, "invited-talk", TALK), (8, "session", GROUP)], "page_id long, kind string, html string")
    details = E.detail_pages(details).select(F.col("page_id").cast("string").alias("id"), "detail")
    joined = entries.join(details, "id").withColumn("day", F.element_at(F.array(F.lit("MON 18 MAY")), F.col("day_no")))
    cleaned = X.clean_frame(joined.drop("page_id", "pos", "day_no", "papers", "room"), "collapsed")
    sessions = N.normalize_entries(cleaned, {"MON 18 MAY": "2026-05-18"}).drop("id")
    rows = {r.title: r for r in sessions.collect()}
    talk, p1, p2 = rows["Big Talk"], rows["P1"], rows["P2"]
    assert (talk.type, talk.date, talk.startTime, talk.endTime, talk.location, talk.speaker, talk.abstract) == (
        "Invited Talk", "2026-05-18", "08:45", "09:05", "Hall A", ["Dr Who"], "On x")
    assert (p1.type, p1.date, p1.startTime, p1.endTime, p1.location, p1.speaker, p1.abstract, p1.topic, p1.sessionUrl) == (
        "Oral Session", "2026-05-18", "13:00", "14:30", "Hall B", ["Ann", "Bob"], "A1", ["Research-Track", "R1: Nets"], "/v/oral/1")
    assert (p2.speaker, p2.abstract, p2.sessionUrl) == ([], None, "")
    flat = {r.title: r for r in N.to_flat_sessions(sessions).collect()}
    assert (flat["P1"].topic, flat["P1"].key_themes) == ("R1: Nets", ["Research-Track", "R1: Nets"])


def test_broken_html_gives_nodes(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b</div><br/>c<script>x<y</script>"), (2, ""), (3, None)], "page_id long, html string")
    rows = E.extract_nodes(pages).orderBy("pos").collect()
    assert [(r.page_id, r.tag) for r in rows] == [(1, "p"), (1, "p"), (1, "br"), (1, "script")]


@pytest.mark.parametrize("text, clock", [
    ("8:45 a.m.", "08:45"), ("1 p.m.", "13:00"), ("12 noon", "12:00"), ("12 a.m.", "00:00"), ("12:30 PM", "12:30"),
    ("10 AM", "10:00"), ("midnight", ""), ("12 midnight", "00:00"), ("soon", ""), ("", ""), (None, ""), ("25:99", "25:99")])
def test_clock(spark, text, clock):
    assert value(spark, S.clock_24h(F.lit(text).cast("string"))) == clock


def test_time_range_reads_the_dotted_form(spark):
    # the pattern as first written never matched a dot followed by a space; ours does
    r = value(spark, S.time_range(F.lit("Tue 19 May 1 p.m. PDT — 2:30 p.m. PDT")))
    assert (r.start, r.end) == ("13:00", "14:30")


def test_dates(spark):
    r = value(spark, S.date_line(F.lit("Mon, May 18, 2026 * 8:45 AM - 9:05 AM PDT")))
    assert tuple(r) == ("2026-05-18", "08:45", "09:05")
    assert value(spark, S.long_date(F.lit("Mon, Apr 20, 2026"))) == ""
    r = value(spark, S.short_date_line(F.lit("Tuesday, May 5 | 8:30 - 9:30 AM"), 2026))
    assert tuple(r) == ("2026-05-05", "08:30", "09:30")


def test_unicode_cleaning(spark):
    raw = "‘a’ “b”–—… ​ ﬁ Ａ"
    assert value(spark, X.clean_text(F.lit(raw))) == "'a' \"b\"--...  fi A"
    assert value(spark, X.clean_text(F.lit(raw), "no_line_separators")) == "'a' \"b\"--...  fi A"
    assert value(spark, X.clean_text(F.lit(" a⋅b\r x000D \n c "), "collapsed")) == "a * b c"


def test_clean_nested_is_idempotent_and_keeps_shape(spark):
    df = spark.createDataFrame([([("“q”：", 1), (None, 2)], {"’": "’"}), (None, None)],
                               "a array<struct<s:string,n:int>>, m map<string,string>")
    once = X.clean_frame(df)
    assert once.schema.simpleString() == df.schema.simpleString()
    assert once.first().a[0].s == '"q":' and once.first().a[1].s is None and once.first().m == {"’": "'"}
    assert X.clean_frame(once).collect() == once.collect()
    assert once.collect()[1].a is None


def test_strip_takes_every_whitespace(spark):
    assert value(spark, X.strip(F.lit("\t   a b\n　"))) == "a b"


@pytest.mark.parametrize("name, plain, strict", [
    ("Acme Inc.", "acme", "acme"), ("Foo Corp. Inc.", "foo", "foo"), ("Bar Co Company", "barco", "barco"), ("  Baz GmbH AG ", "bazgmbhag", "bazgmbhag"),
    ("X.com", "xcom", "x"), ("Y (Z) LLC", "yz", "y"), ("???", None, None), (None, None, None)])
def test_company_url(spark, name, plain, strict):
    url = lambda n: None if n is None else f"https://www.{n}.com/"
    assert value(spark, U.company_url(F.lit(name).cast("string"))) == url(plain)
    assert value(spark, U.company_url(F.lit(name).cast("string"), strict=True)) == url(strict)


def test_known_company_goes_by_lower_case(spark):
    df = spark.createDataFrame([("Wistron & Wiwynn",), ("DREAM",), ("Other",)], "name string")
    known = spark.createDataFrame(list(U.KNOWN_COMPANIES.items()), "name string, value string")
    got = R.override_by_name(df, known, "name", U.company_url(F.col("name")), "url")
    assert {r.name: r.url for r in got.collect()} == {
        "Wistron & Wiwynn": "https://www.wiwynn.com/", "DREAM": "https://dreamgroup.com/", "Other": "https://www.other.com/"}


def test_all_urls_are_whole(spark):
    urls = value(spark, U.all_urls(F.lit("see http://www.a.org/x?y, or https://b-c.co.uk.")))
    assert urls == ["http://www.a.org/x?y,", "https://b-c.co.uk"]


def test_slice_after(spark):
    cut = lambda t: value(spark, X.slice_after(F.lit(t), "Abstract:", ["\nChat\n", "\nDirectory"]))
    assert cut("x Abstract: body\nDirectory z\nChat\n") == "body"
    assert cut("Abstract: body") == "body"
    assert cut("no marker") == ""


def test_schedule_line_skips_navigation(spark):
    col = lambda t: S.schedule_line(X.lines(F.lit(t)))
    got = value(spark, col("a\n Monday, March 16  |  11:00 a.m. - 1:00 p.m. PDT \nHall 1\nb"))
    assert tuple(got)[:3] == ("Monday, March 16", "11:00 a.m. - 1:00 p.m. PDT", "Hall 1")
    assert value(spark, col("Monday, March 16 | 11:00 a.m. - 1 p.m. PDT\nSession Catalog")).location == ""
    assert tuple(value(spark, col("nothing"))) == ("", "", "", "")


def test_takeaways_fall_back_to_text(spark):
    none = F.array().cast("array<string>")
    text = "Key Takeaways:\nfirst\n• second\n- Register here\n\nAdd to Schedule\nx"
    assert value(spark, E.takeaways(none, F.lit(text))) == ["first", "second"]
    assert value(spark, E.takeaways(F.array(F.lit(" a "), F.lit(" ")), F.lit(text))) == ["a"]


def test_speakers_need_a_bar(spark):
    got = value(spark, L.speaker_structs(F.array(F.lit("Ann | CTO | Co"), F.lit("Bo | Co"), F.lit("nobody"))))
    assert [tuple(p) for p in got] == [("Ann", "CTO", "Co"), ("Bo", "", "Co")]


TITLES = [(1, "9:00am - 5:00pm Full title", 1), (1, "Full ti...", 2), (2, "Cut...", 1), (2, "Cut more...", 2), (3, "Old", 1), (3, "New", 2)]


def test_full_titles_and_compat(spark):
    df = spark.createDataFrame(TITLES, "url int, title string, pos int")
    full = {r.url: r.title for r in D.prefer_full_titles(df, "url", "title", ["pos"]).collect()}
    compat = {r.url: r.title for r in D.prefer_full_titles(df, "url", "title", ["pos"], "compat").collect()}
    assert full == {1: "Full title", 2: "Cut...", 3: "New"}
    assert compat == {1: "Full ti...", 2: "Cut...", 3: "New"}


def test_diff_invariants(spark):
    old = spark.createDataFrame([(i, f"t{i}") for i in range(0, 80)], "id int, title string")
    new = spark.createDataFrame([(i, f"t{i}") for i in range(30, 100)], "id int, title string")
    stats = R.diff_stats(R.snapshot_diff(old, new, "id")).first()
    assert stats.added + stats.common == stats.now == 70
    assert stats.removed + stats.common == stats.previously == 80
    assert stats.net_change == -10
    same = R.diff_stats(R.snapshot_diff(old, old, "id")).first()
    assert (same.added, same.removed) == (0, 0)


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, t string, at int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, t string, at int")
    once = R.upsert(base, new, "id", ["at"])
    twice = R.upsert(once, new, "id", ["at"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.id: r.t for r in once.collect()} == {1: "a", 2: "d", 3: "e"}


def test_pending_ignores_missing_keys(spark):
    inputs = spark.createDataFrame([("a",), ("b",), ("",)], "id string")
    done = spark.createDataFrame([("a",), (None,), ("",)], "id string")
    assert sorted(r.id for r in R.pending(inputs, done, "id").collect()) == ["", "b"]


def test_dangling_reference(spark):
    rows = spark.createDataFrame([(1, ["P1", "P none", "P2"]), (2, [])], "id int, titles array<string>")
    known = spark.createDataFrame([("P1",), ("P2",), ("P2",)], "t string")
    got = {r.id: (r.resolved, r.dangling) for r in R.check_references(rows, "id", "titles", known, "t").collect()}
    assert got == {1: (["P1", "P2"], ["P none"]), 2: ([], [])}


def test_flat_session_json_drops_absent_fields(spark):
    df = spark.createDataFrame(
        [("T", "Talk", "2026-05-19", "09:00", "10:00", "", "/s", [], ["Ann"])],
        "title string, type string, date string, startTime string, endTime string, location string, sessionUrl string, topic array<string>, speaker array<string>")
    row = N.to_flat_sessions(df).select(F.to_json(F.struct("*")).alias("j")).first()
    doc = json.loads(row.j)
    assert "room" not in doc and "key_themes" not in doc and doc["speakers"] == [{"name": "Ann"}] and doc["topic"] == ""


def test_validation_rules(spark):
    rows = spark.createDataFrame([("2026-01-02", "09:00", "24:00", "Both", None)], "date string, start string, end string, format string, recording string")
    assert Q.validate(rows, Q.flat_session_rules()).first().errors == ["end"]


def test_upload_batches_keep_rows_without_a_key(spark):
    df = spark.createDataFrame([(i if i % 5 else None,) for i in range(25)], "id long")
    got = Q.upload_batches(df, "id", size=4).groupBy("batch").count().orderBy("batch").collect()
    assert [(r.batch, r["count"]) for r in got] == [(i, 4) for i in range(6)] + [(6, 1)]
    assert Q.upload_batches(df.limit(0), "id").count() == 0
    assert Q.upload_batches(df.filter("id is null"), "id").count() == 5


def test_envelopes_hold_one_venue_and_at_most_the_limit(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "A" if i % 3 else "B") for i in range(30)], "id long, title string, v string")
    sinks.write_envelopes(df, str(tmp_path / "e"), "sessions", "id", F.col("v"), F.lit(2026), size=7)
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "e")).collect()]
    assert all(len(d["sessions"]) <= 7 and len({s["v"] for s in d["sessions"]}) == 1 for d in docs)
    assert sorted(s["id"] for d in docs for s in d["sessions"]) == list(range(30))


def test_per_unit_names(spark):
    assert value(spark, sinks.safe_name(F.lit('a<b>:"/\\|?*c'))) == "a_b" + "_" * 8 + "c"


def test_cascade_with_own_model_hooks(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def by_length(record: pd.Series, unit: pd.Series) -> pd.Series:
        return record.str.len().astype(float)

    records = spark.createDataFrame([(i, "word " * i) for i in range(1, 9)], "rid long, t string")
    units = spark.createDataFrame([(1, "word")], "uid long, q string")
    got = M.cascade(records, units, "rid", "uid", "t", "q", 6, 3, prepare=M.as_text, scorer=by_length,
                    generator=lambda r, u: F.concat(u, F.lit("!"))).collect()
    assert [(r.rid, r["rank"], r.recommendation_reason) for r in sorted(got, key=lambda r: r["rank"])] == [
        (6, 1, "word!"), (5, 2, "word!"), (4, 3, "word!")]


def test_containers_that_nest_in_their_own_kind(spark):
    html = '<div class="c"><div class="c"><b>x</b></div><i>y</i></div><u>z</u>'
    pages = spark.createDataFrame([("S1", html)], "page_id string, html string")
    nodes = E.extract_nodes(pages, containers={"at": [E.Container("div", ("c",))]})
    assert [(r.page_id, r.tag, r["at"]) for r in nodes.orderBy("pos").collect()] == [
        ("S1", "div", 0), ("S1", "div", 1), ("S1", "b", 1), ("S1", "i", 0), ("S1", "u", None),
    ]


def test_short_date_lines_over_noon(spark):
    from recordloom.functions.schedule import clock_24h, date_line, short_date_line

    lines = {
        "Tuesday, May 5 | 11:30 - 12:30 PM": ("2026-05-05", "11:30", "12:30"),
        "Tuesday, May 5 | 8:30 - 9:30 AM": ("2026-05-05", "08:30", "09:30"),
        "Tuesday, May 5 | 8:30 - 9:30 pm": ("2026-05-05", "20:30", "21:30"),
        "Tuesday, May 5 | 11 AM – 1:15 PM": ("2026-05-05", "11:00", "13:15"),
        "Tuesday, May 5 | 10 - 1 PM": ("2026-05-05", "10:00", "13:00"),
        "Tuesday, May 5 | 11 PM - 12:30 AM": ("2026-05-05", "23:00", "00:30"),
        "Tuesday, May 5 | 11:30 - 12:30 AM": ("2026-05-05", "23:30", "00:30"),
        "Tuesday, Apr 31 | soon": ("", "", ""),
        "Tuesday, April 31 | 1 - 2 PM": ("", "13:00", "14:00"),
        None: ("", "", ""),
    }
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = {r["x"]: tuple(r["d"]) for r in df.select("x", short_date_line(F.col("x"), 2026).alias("d")).collect()}
    assert got == lines
    dates = {"Mon, february 29, 2024 * 9 AM - 10 AM": "2024-02-29", "Mon, February 29, 2100": "", "Mon, May 0, 2026": "", "Sun, Sept 1, 2026": "", "x": ""}
    df = spark.createDataFrame([(x,) for x in dates], "x string")
    assert {r["x"]: r["d"]["date"] for r in df.select("x", date_line(F.col("x")).alias("d")).collect()} == dates
    clocks = {" 8:45 a.m.\n": "08:45", "1 p.m.": "13:00", "12 noon": "12:00", "12 midnight": "00:00", "123": "123:00", "9\t": "09:00", "8 x": "", "\u00a08 PM": "20:00", "": "", "8:5": "08:05", "9" * 30: ""}
    df = spark.createDataFrame([(x,) for x in clocks], "x string")
    assert {r["x"]: r["c"] for r in df.select("x", clock_24h(F.col("x")).alias("c")).collect()} == clocks


def test_event_types_in_title_case(spark):
    from recordloom.functions.lists import class_type

    texts = ["q&a-panel", "affinity-event", "they're here", "3d-talk", "x2y (panel)", "éte/äpfel", "ALL-CAPS", "日本a b"]
    df = spark.createDataFrame([(["pad", "room-a", t],) for t in texts], "c array<string>")
    got = [r[0] for r in df.select(class_type(F.col("c"))).collect()]
    assert got == [t.replace("-", " ").title() for t in texts]
