"""Programme pages as node tables -> event, row and detail records.

All groups are per page (or per element of a page), and the nodes of a page come from one input
row: the parser knows what is first in them, so no job shuffles or sorts its nodes. A job's mapping
names the columns it reads, its ``_ROWS`` the groups whose first nodes are its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.lists import class_type, room_of
from recordloom.functions.schedule import end_time
from recordloom.functions.text import collapse, first_value, missing, or_empty, strip
from recordloom.functions.urls import without_fragment
from recordloom.operators.dedup import first_wins
from recordloom.operators.extract import Above, All, Container, First

_LINK = Container("a")
_SELF = Container()  # fits the first element of a group


def _div(*names: str) -> Container:
    return Container("div", names)


_SESSION = Container("div", classes="(oral|poster)-session")
_TIMED = ("day_at", "box_at")
#: The containers and columns that each job wants from ``extract_nodes``.
EVENTS = {
    "day_at": [Container("div", classes="container2.*day-")],
    "box_at": [_div("timebox")],
    "event_at": [_div("eventsession")],
    "block_at": [_SESSION],
    "part_at": [_div("eventblock")],
    "item_at": [Container("div", classes=r"content\s+(oral|poster)")],
    "booth_at": [_div("exhibitor-spot-talks")],
    "talk_at": [Container("div", classes="^content talk$")],
    "title_at": [_div("title-style")],
    "day_text": First(("day_at",), _div("hdrbox")),
    "box_text": First(("box_at",), _div("time")),
    "box_depth": First(("box_at",), _SELF, "depth"),
    "date": Above("day_text"),
    "box_above": Above("box_text"),
    "event_title": First(("event_at",), _div("title-style"), within=_TIMED),
    "event_link": First(("event_at",), _LINK, within=("title_at", *_TIMED)),
    "event_href": First(("event_at",), _LINK, "href", within=("title_at", *_TIMED)),
    "event_header": First(("event_at",), _div("hdr-style"), within=_TIMED),
    "end_note": First(("event_at",), Container("span", ("end-time",)), within=_TIMED),
    "block_classes": First(("block_at",), _SESSION, "class", within=_TIMED),
    "header": First(("part_at",), _div("subevent-header"), within=_TIMED),
    "header_classes": First(("part_at",), _div("subevent-header"), "classes", within=_TIMED),
    "item_link": First(("item_at",), _LINK, within=_TIMED),
    "item_href": First(("item_at",), _LINK, "href", within=_TIMED),
    "talk_link": First(("talk_at",), _LINK, within=_TIMED),
    "talk_href": First(("talk_at",), _LINK, "href", within=_TIMED),
}
EVENT_ROWS = [("event_at",), ("item_at",), ("talk_at",)]
_ROW = ("day_at", "row_at")
_MODAL = Container("a", attr="data-event-modal")
ROWS = {
    "day_at": [_div("day-wrapper")],
    "row_at": [Container("tr", attr="data-slot-id")],
    "muted_at": [Container(has=("text-muted",))],
    "people_at": [Container(has=("performers",))],
    "day": First(("day_at",), Container("h4", ("day-header",))),
    "days": All((), _div("day-wrapper"), values=("pos", "day")),
    "part_at": First(_ROW, _SELF, "pos"),
    "data_event_modal": First(_ROW, _MODAL, "data-event-modal"),
    "title": First(_ROW, _MODAL),
    "start_time": First(_ROW, Container(has=("start-time",))),
    "duration": First(_ROW, Container("strong"), within=("muted_at",)),
    "event_type": First(_ROW, Container(has=("event-type",))),
    "track": First(_ROW, Container(has=("prog-track",))),
    "people": All(_ROW, Container("a", ("navigate",)), within=("people_at",), values=("end_pos", "text", "href")),
    "places": All(_ROW, Container(has=("prog-aff",)), values=("pos", "text")),
}
TABLE_ROWS = [_ROW]
DETAILS = {
    "head_at": [Container(has=("modal-header",))],
    "text_at": [Container(has=("event-description",))],
    "person_at": [Container(has=("media",))],
    "link_at": [_LINK],
    "person_name": First(("person_at",), Container(has=("media-heading",))),
    "person_place": First(("person_at",), Container(has=("text-black",))),
    "person_country": First(("person_at",), Container("small")),
    "link_href": First(("link_at",), _SELF, "href"),
    "track_full_name": First((), Container(has=("text-muted",)), within=("head_at",)),
    "datetime_str": First((), Container("strong"), within=("head_at",)),
    "session_name": First((), Container("a", ("navigate",)), within=("head_at",)),
    "room": First((), Container("a", ("room-link",)), within=("head_at",)),
    "paragraphs": All((), Container("p"), within=("text_at",)),
    "people": All((), Container(has=("media",)), values=("person_name", "person_place", "person_country", "link_at", "link_href")),
}
DETAIL_ROWS = [()]
_BLOCK = ("day_at", "block_at")
ENTRIES = {
    "day_at": [_div("days")],
    "box_at": [Container(has=("timebox",))],
    "block_at": [_div("eventsession", "pad"), _div("session", "pad")],
    "title_at": [_div("title-style"), _div("sessiontitle")],
    "content_at": [_div("content")],
    "days": All((), _div("days"), values=("pos",)),
    "no_day": First((), _SELF, "pos", outside="day_at"),
    "part_at": First(_BLOCK, _SELF, "pos"),
    "start_raw": First(("box_at",), Container(has=("time",))),
    "url": First(_BLOCK, _LINK, "href", within=("title_at",)),
    "title": First(_BLOCK, _LINK, within=("title_at",)),
    "end_note": First(_BLOCK, Container(has=("end-time",))),
    "label": First(_BLOCK, Container(has=("hdr-style",))),
    "speaker_on_calendar": First(_BLOCK, Container(has=("speaker-style",))),
    "papers": All(_BLOCK, _LINK, within=("content_at",), values=("text", "href")),
}
ENTRY_ROWS = [_BLOCK]


def item_type(item_classes: Column, header_classes: Column, block_classes: Column) -> Column:
    """Type of a listed item: its own class, else the header's, else the block's."""
    own = [(item_classes, "oral"), (item_classes, "poster"), (header_classes, "oral"), (header_classes, "poster")]
    chain = F.lit("Session")
    chain = F.when(block_classes.contains("poster-session"), "Poster").otherwise(chain)
    chain = F.when(block_classes.contains("oral-session"), "Oral").otherwise(chain)
    for classes, name in reversed(own):
        chain = F.when(F.coalesce(F.array_contains(classes, name), F.lit(False)), name.title()).otherwise(chain)
    return chain


def item_times(text: Column, header: Column, box_time: Column) -> tuple[Column, Column]:
    """(start, end) of a listed item: its '[10:30]', else the header's range, else the box time."""
    span = F.regexp_extract(or_empty(header), r"(\d+:\d+-\d+:\d+)", 1)
    start = F.coalesce(
        F.nullif(F.regexp_extract(text, r"\[(\d+:\d+)\]", 1), F.lit("")),
        F.nullif(F.substring_index(span, "-", 1), F.lit("")),
        box_time,
    )
    return start, F.when(span != "", F.substring_index(span, "-", -1)).otherwise("")


def calendar_events(nodes: DataFrame, base: str, inherit_time: bool = True) -> DataFrame:
    """Events, listed talks and posters, and exhibitor talks of calendar pages (nodes with EVENTS).

    A time box without a time takes the one above it, or '' when ``inherit_time`` is off; a day
    without a text takes the one above it. One pass over the nodes, without a shuffle.
    """
    texts = ["text", "date", "event_title", "event_link", "event_header", "end_note", "header", "item_link", "talk_link"]
    n = nodes.filter(F.col("day_at").isNotNull() & F.col("box_at").isNotNull())
    n = n.withColumns({
        **{c: strip(c) for c in texts},
        "time": strip("box_above") if inherit_time else or_empty(strip("box_text")),
        "block_classes": or_empty(F.col("block_classes")),
    })
    is_event = (
        (F.col("pos") == F.col("event_at"))
        & (F.col("depth") == F.col("box_depth") + 1)
        & F.col("event_title").isNotNull()
    )
    is_item = (
        (F.col("pos") == F.col("item_at")) & F.col("block_at").isNotNull() & F.col("part_at").isNotNull()
    )
    is_talk = (
        (F.col("pos") == F.col("talk_at")) & F.col("booth_at").isNotNull() & F.col("talk_link").isNotNull()
    )
    kind = F.when(is_event, "event").when(is_item, "item").when(is_talk, "talk")
    rows = n.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    event, item = F.col("kind") == "event", F.col("kind") == "item"
    start, end = item_times(F.col("text"), F.col("header"), F.col("time"))
    link = F.when(event, F.col("event_link")).when(item, F.col("item_link")).otherwise(F.col("talk_link"))
    target = F.when(event, F.col("event_href")).when(item, F.col("item_href")).otherwise(F.col("talk_href"))
    plain = F.when(event, F.col("event_title")).otherwise(F.regexp_replace("text", r"^\[\d+:\d+\]\s*", ""))
    return rows.select(
        "page_id",
        "pos",
        F.coalesce(link, plain).alias("title"),
        "date",
        F.when(item, start).otherwise(F.col("time")).alias("time"),
        F.when(event, end_time(F.col("end_note"))).when(item, end).otherwise("").alias("end_time"),
        F.lit("").alias("speaker"),
        F.when(event, class_type(F.col("classes"), or_empty(F.col("event_header"))))
        .when(item, item_type(F.col("classes"), F.col("header_classes"), F.col("block_classes")))
        .otherwise("Exhibitor Talk")
        .alias("session_type"),
        F.when(link.isNotNull(), F.concat(F.lit(base), or_empty(target))).otherwise("").alias("url"),
        F.lit("").alias("abstract"),
    ).filter(~missing(F.col("title")))


def table_rows(nodes: DataFrame, day_label: str) -> DataFrame:
    """Programme table rows (nodes with ROWS) of the first day whose header starts with the label, once per uuid."""
    first_day = F.get(F.filter("days", lambda d: strip(d["day"]).startswith(day_label)), 0)["pos"]
    rows = nodes.filter((F.col("pos") == F.col("part_at")) & (F.col("day_at") == first_day) & F.col("row_at").isNotNull())
    texts = {c: or_empty(strip(c)) for c in ("title", "start_time", "duration", "event_type", "track")}
    person = lambda p: F.struct(p["end_pos"], strip(p["text"]).alias("name"), or_empty(p["href"]).alias("url"))
    place = lambda p: F.struct(p["pos"], strip(p["text"]))
    rows = rows.select(
        "page_id",
        "row_at",
        "data_event_modal",
        *[c.alias(name) for name, c in texts.items()],
        F.filter(F.transform("people", person), lambda p: p["name"] != "").alias("people"),
        F.map_from_entries(F.transform("places", place)).alias("places"),
    )
    authors = F.transform(
        "people",
        lambda p: F.struct(
            p["name"].alias("name"),
            or_empty(F.element_at("places", p["end_pos"] + 1)).alias("affiliation"),
            p["url"].alias("profile_url"),
        ),
    )
    found = rows.filter(F.col("data_event_modal").isNotNull()).withColumn("authors", authors)
    return first_wins(found.drop("people", "places"), ["page_id", "data_event_modal"], ["row_at"]).drop("row_at")


def detail_rows(nodes: DataFrame) -> DataFrame:
    """One record per detail page (nodes with DETAILS): track, time, room, session, abstract paragraphs, people."""
    person = lambda p: F.struct(
        strip(p["person_name"]).alias("name"),
        or_empty(strip(p["person_place"])).alias("affiliation"),
        or_empty(strip(p["person_country"])).alias("country"),
        or_empty(F.when(p["link_at"].isNotNull(), p["link_href"])).alias("profile_url"),
    )
    paragraphs = F.filter(F.transform("paragraphs", lambda p: strip(p["text"])), lambda t: t != "")
    return nodes.filter("pos = 0").select(
        "page_id",
        *[or_empty(strip(c)).alias(c) for c in ("track_full_name", "datetime_str", "session_name", "room")],
        F.array_join(paragraphs, "\n\n").alias("abstract"),
        F.filter(F.transform("people", person), lambda p: ~missing(p["name"])).alias("authors"),
    )


def calendar_entries(nodes: DataFrame, path: str) -> DataFrame:
    """Top-level calendar blocks (nodes with ENTRIES): kind and id from the link, times, label, room, listed papers."""
    n = nodes.filter((F.col("pos") == F.col("part_at")) & F.col("block_at").isNotNull() & F.col("day_at").isNotNull())
    # what is outside all days counts as one, before them
    days = F.size(F.filter("days", lambda d: d["pos"] <= F.col("day_at"))) + F.col("no_day").isNotNull().cast("int")
    paper = lambda p: F.struct(collapse(p["text"]).alias("title"), without_fragment(p["href"]).alias("url"))
    texts = ("title", "start_raw", "end_note", "label", "speaker_on_calendar")
    blocks = n.select(
        "page_id",
        days.alias("day_no"),
        F.col("block_at").alias("pos"),
        or_empty(without_fragment(F.col("url"))).alias("url"),
        *[or_empty(collapse(F.col(c))).alias(c) for c in texts],
        F.when(F.col("pos") == F.col("block_at"), room_of(F.col("classes"))).alias("room"),
        F.transform("papers", paper).alias("papers"),
    )
    pattern = path + r"([a-z-]+)/(\d+)"
    kind = F.regexp_extract("url", pattern, 1)
    default_label = F.when(kind == "invited-talk", "Invited Talk").otherwise("Session")
    return blocks.filter(F.col("url").rlike(pattern)).select(
        "page_id",
        "pos",
        "day_no",
        kind.alias("kind"),
        F.regexp_extract("url", pattern, 2).alias("id"),
        "url",
        "title",
        "start_raw",
        F.regexp_replace(F.regexp_replace("end_note", r"^\(ends\s*", ""), r"\)$", "").alias("end_raw"),
        first_value(strip(F.regexp_replace("label", ":$", "")), default_label).alias("kind_label"),
        "speaker_on_calendar",
        "room",
        "papers",
    )
