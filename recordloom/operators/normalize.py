"""Calendar entries with details -> session records, and the published formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.lists import split_people
from recordloom.functions.schedule import clock_24h, date_line, time_range
from recordloom.functions.text import collapse, empty, first_value, missing, or_empty, strip

# The label texts that decide type and track.
TRACKS = ["Research-Track", "Industry-Track"]
GROUP_TYPE = "Paper Session"
ITEM_TYPE = "Oral Session"

_TIME_BRACKET = r"\s*\[\d{1,2}:\d{2}\s*[-–—]\s*\d{1,2}:\d{2}\]\s*$"


def clean_title(detail: Column, calendar: Column) -> Column:
    """The detail page's title, else the calendar's, without a trailing '[8:30-10:00]'."""
    return collapse(F.regexp_replace(strip(first_value(detail, calendar)), _TIME_BRACKET, ""))


def entry_type(kind: Column, label: Column, title: Column) -> Column:
    return (
        F.when(label == "Keynote Talk", "Keynote")
        .when((label == "Invited Talk") | (kind == "invited-talk"), "Invited Talk")
        .when(F.contains(title, F.lit("Oral Presentation")), GROUP_TYPE)
        .otherwise("Session")
    )


def entry_topic(title: Column) -> Column:
    return first_value(strip(F.regexp_extract(title, r"^.*Oral Presentation:\s*(.+)$", 1)), title)


def entry_track(title: Column) -> Column:
    chain = F.lit("")
    for track in reversed(TRACKS):
        chain = F.when(F.contains(title, F.lit(track)), track).otherwise(chain)
    return chain


def normalize_entries(entries: DataFrame, dates: Mapping[str, str]) -> DataFrame:
    """One session per entry, or one per paper of a grouped session.

    ``entries`` has kind, kind_label, title, day, start_raw, end_raw, url,
    speaker_on_calendar and detail: struct<title, room, date_line, time_line, speaker,
    abstract, papers: array<struct<title, url, authors, abstract>>>. The detail page goes
    before the calendar. All in one narrow pass: an entry becomes an array of sessions
    that is then laid out as rows. Columns not named above stay.
    """
    d = F.col("detail")
    talk = F.col("kind") == "invited-talk"
    date_of = F.create_map(*[F.lit(x) for pair in dates.items() for x in pair])
    e = entries.withColumns(
        {
            "_type": entry_type(F.col("kind"), F.col("kind_label"), or_empty(F.col("title"))),
            "_title": clean_title(d["title"], F.col("title")),
            "_track": entry_track(or_empty(F.col("title"))),
            "_line": date_line(d["date_line"]),
            "_range": time_range(d["time_line"]),
            "_papers": F.coalesce(d["papers"], F.array().cast(entries.select("detail.papers").dtypes[0][1])),
        }
    ).withColumn("_topic", entry_topic(F.col("_title")))
    start = F.when(talk, F.col("_line.start")).otherwise(F.col("_range.start"))
    end = F.when(talk, F.col("_line.end")).otherwise(F.col("_range.end"))
    calendar_speaker = strip(or_empty(F.col("speaker_on_calendar")))
    people = F.array_distinct(F.flatten(F.transform("_papers", lambda p: split_people(p["authors"]))))
    one = lambda c: F.filter(F.array(c), lambda x: x != "")
    e = e.withColumns(
        {
            "date": first_value(F.when(talk, F.col("_line.date")), F.try_element_at(date_of, or_empty(F.col("day")))),
            "startTime": first_value(start, clock_24h(F.col("start_raw"))),
            "endTime": first_value(end, clock_24h(F.col("end_raw"))),
            "location": or_empty(d["room"]),
            "_people": F.when(talk, one(first_value(strip(or_empty(d["speaker"])), F.col("speaker_on_calendar"))))
            .when(~empty(F.col("_papers")), people)
            .otherwise(one(calendar_speaker)),
        }
    )
    shared = lambda **over: F.struct(
        over["title"].alias("title"),
        over["type_"].alias("type"),
        over["url"].alias("sessionUrl"),
        over["topic"].alias("topic"),
        over["speaker"].alias("speaker"),
        over["abstract"].alias("abstract"),
        over["publications"].alias("publicationTitles"),
    )
    no_titles = F.lit(None).cast("array<string>")
    items = F.transform(
        "_papers",
        lambda p: shared(
            title=p["title"],
            type_=F.lit(ITEM_TYPE),
            url=p["url"],
            topic=F.filter(F.array("_track", "_topic"), lambda x: x != ""),
            speaker=split_people(p["authors"]),
            abstract=F.nullif(p["abstract"], F.lit("")),
            publications=no_titles,
        ),
    )
    single = F.array(
        shared(
            title=F.col("_title"),
            type_=F.col("_type"),
            url=F.col("url"),
            topic=one(F.col("_topic")),
            speaker=F.col("_people"),
            abstract=F.when(talk, F.nullif(d["abstract"], F.lit(""))),
            publications=F.when(~empty(F.col("_papers")), F.transform("_papers", lambda p: p["title"])),
        )
    )
    grouped = (F.col("_type") == GROUP_TYPE) & ~empty(F.col("_papers"))
    used = {"kind", "kind_label", "title", "day", "start_raw", "end_raw", "url", "speaker_on_calendar", "detail"}
    kept = [c for c in entries.columns if c not in used]
    return e.withColumn("_sessions", F.when(grouped, items).otherwise(single)).select(
        *kept,
        "date",
        "startTime",
        "endTime",
        "location",
        F.lit("IN_PERSON").alias("sessionFormat"),
        F.lit(False).alias("hasRecording"),
        # never empty; the outer form keeps Spark from adding a size filter that builds them twice
        F.inline_outer("_sessions"),
    )


def to_flat_sessions(sessions: DataFrame) -> DataFrame:
    """Envelope sessions -> the flat upload format; optional fields are null when absent."""
    subject = F.get(F.filter("topic", lambda t: ~t.isin(TRACKS)), 0)
    return sessions.select(
        "title",
        "date",
        F.col("startTime").alias("start"),
        F.col("endTime").alias("end"),
        F.col("type").alias("session_type"),
        or_empty(subject).alias("topic"),
        F.col("sessionUrl").alias("url"),
        F.lit("In-Person").alias("format"),
        F.transform(
            F.coalesce("speaker", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"))
        ).alias("speakers"),
        F.when(~missing(F.col("location")), F.col("location")).alias("room"),
        F.when(~empty(F.col("topic")), F.col("topic")).alias("key_themes"),
    )
