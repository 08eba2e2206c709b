"""Clock text, time ranges and date lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import let, or_empty, strip

# The shapes of clock times.
_CLOCK = r"^(\d+)(?::(\d+))?(am|pm|noon|midnight)?$"
_DOTTED = r"\d{1,2}(?::\d{2})?\s*(?:a\.m\.|p\.m\.)"
_PLAIN = r"\d{1,2}(?::\d{2})?\s*(?:AM|PM)"


def clock_24h(c: Column) -> Column:
    """'8:45 a.m.', '1 p.m.', '10 AM', '12 noon' -> 'HH:MM'; anything else -> ''."""

    def read(s: Column) -> Column:
        return F.struct(
            F.regexp_extract(s, _CLOCK, 1).try_cast("bigint").alias("hour"),
            F.regexp_extract(s, _CLOCK, 2).try_cast("bigint").alias("minute"),
            F.regexp_extract(s, _CLOCK, 3).alias("half"),
        )

    def show(t: Column) -> Column:
        hour, half = t["hour"], t["half"]
        hour24 = (
            F.when((half == "pm") & (hour != 12), hour + 12)
            .when(((half == "am") & (hour == 12)) | (half == "midnight"), F.lit(0))
            .when(half == "noon", F.lit(12))
            .otherwise(hour)
        )
        text = F.format_string("%02d:%02d", hour24, F.coalesce(t["minute"], F.lit(0)))
        return F.when(hour.isNotNull(), text).otherwise("")

    bare = F.regexp_replace(F.lower(strip(or_empty(c))), r"[. ]", "")
    return F.when(bare != "", let(let(bare, read), show)).otherwise("")


def time_range(c: Column) -> Column:
    """'Tue 19 May 1 p.m. PDT - 2:30 p.m. PDT' -> struct(start, end), '' where unreadable."""
    pattern = rf"(?i)\b({_DOTTED}).*?-\s*({_DOTTED})"

    def convert(s: Column) -> Column:
        return F.struct(
            clock_24h(F.regexp_extract(s, pattern, 1)).alias("start"),
            clock_24h(F.regexp_extract(s, pattern, 2)).alias("end"),
        )

    return let(F.regexp_replace(or_empty(c), r"\s+(--|—|-)\s+", " - "), convert)


# The month names that count.
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
    "November", "December",
]


# The shapes of dates and of times from and to.
_LONG_DATE = r"(Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s*(\w+)\s+(\d{1,2}),\s*(\d{4})"
_SHORT_DATE = r"(\w+day),\s*(\w+)\s+(\d{1,2})"
_FROM_TO = rf"(?i)({_PLAIN})\s*[-–—]\s*({_PLAIN})"
_SHORT_FROM_TO = r"(?i)(\d{1,2}(?::\d{2})?)\s*(AM|PM)?\s*[-–—]\s*(\d{1,2}(?::\d{2})?)\s*(AM|PM)"


def long_date(c: Column) -> Column:
    """'Mon, May 18, 2026 ...' -> '2026-05-18'; only full month names count, else ''."""
    month, day, year = (F.regexp_extract(c, _LONG_DATE, i) for i in (2, 3, 4))
    return _iso_date(F.initcap(month), day, year)


def _iso_date(month: Column, day: Column, year: Column) -> Column:
    """'2026-05-18', '' when it is no date. Only full month names reach the parser."""
    parsed = F.try_to_timestamp(F.concat_ws(" ", month, day, year), F.lit("MMMM d yyyy"))
    return F.coalesce(F.when(month.isin(MONTHS), F.date_format(parsed, "yyyy-MM-dd")), F.lit(""))


def date_line(c: Column) -> Column:
    """'Mon, May 18, 2026 * 8:45 AM - 9:05 AM PDT' -> struct(date, start, end)."""
    c = or_empty(c)
    return F.struct(
        long_date(c).alias("date"),
        clock_24h(F.regexp_extract(c, _FROM_TO, 1)).alias("start"),
        clock_24h(F.regexp_extract(c, _FROM_TO, 2)).alias("end"),
    )


def short_date_line(c: Column, year: int) -> Column:
    """'Tuesday, May 5 | 8:30 - 9:30 AM' of a known year -> struct(date, start, end).

    A start without AM/PM takes the half day of the end, or the other one where it would
    come after the end: '11:30 - 12:30 PM' starts before noon.
    """
    c = or_empty(c)
    month = F.regexp_extract(c, _SHORT_DATE, 2)
    date = _iso_date(F.initcap(month), F.regexp_extract(c, _SHORT_DATE, 3), F.lit(str(year)))
    start, own, end, half = (F.regexp_extract(c, _SHORT_FROM_TO, i) for i in (1, 2, 3, 4))
    read = F.struct(
        clock_24h(F.concat(start, F.coalesce(F.nullif(own, F.lit("")), half))).alias("start"),
        clock_24h(F.concat(end, half)).alias("end"),
        (own == "").alias("open"),
    )

    def show(t: Column) -> Column:
        hour = (F.left(t["start"], F.lit(2)).try_cast("int") + 12) % 24
        other = F.concat(F.format_string("%02d", hour), F.substr(t["start"], F.lit(3)))
        starts = F.when(t["open"] & (t["start"] > t["end"]), other).otherwise(t["start"])
        return F.struct(starts.alias("start"), t["end"].alias("end"))

    return let(F.struct(date.alias("date"), let(read, show).alias("t")), lambda d: F.struct(d["date"].alias("date"), d["t"]["start"].alias("start"), d["t"]["end"].alias("end")))


def end_time(c: Column) -> Column:
    """'(ends 11:00 AM)' -> '11:00 AM', '' when no clock text is there."""
    return F.regexp_extract(or_empty(c), r"(?i)(\d+:\d+\s*(?:AM|PM)?)", 1)


def end_note(c: Column) -> Column:
    """The other reading of an end note: text without brackets and the word 'ends'."""
    c = or_empty(c)
    return F.when(
        F.lower(c).contains("ends"),
        strip(F.replace(F.regexp_replace(c, r"[()]", ""), F.lit("ends"), F.lit(""))),
    ).otherwise("")


_WEEKDAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
# A line holding one of these words is page navigation, not a place.
NAVIGATION_WORDS = [
    "explore", "conference", "session catalog", "speakers", "networking", "exhibit", "workshops",
    "startups", "poster", "pricing", "sponsors", "travel", "code of conduct", "contact", "faq",
    "privacy",
]


def schedule_line(lines_col: Column, months: str = "March|April", zones: str = "PDT|PST") -> Column:
    """Find the 'Day, Month D | time ... zone' line -> struct(date, time, location, raw).

    The line after it is the location, unless it is a navigation entry.
    """
    pattern = rf"({_WEEKDAYS}),\s*({months})\s*\d+\s*\|\s*[\d:]+.+?(?:{zones})"
    at = F.array_position(F.transform(lines_col, lambda x: x.rlike(pattern)), F.lit(True))

    def build(hit: Column) -> Column:
        raw = or_empty(hit["raw"])
        after = or_empty(hit["after"])
        nav = F.exists(
            F.array(*[F.lit(w) for w in NAVIGATION_WORDS]), lambda w: F.contains(F.lower(after), w)
        )
        parts = F.transform(F.split(raw, r"\|"), strip)
        return F.struct(
            F.when(F.size(parts) >= 2, parts[0]).otherwise("").alias("date"),
            F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 2, F.size(parts)), "|"))
            .otherwise("")
            .alias("time"),
            F.when(nav, "").otherwise(after).alias("location"),
            raw.alias("raw"),
        )

    hit = F.struct(
        F.when(at > 0, F.get(lines_col, (at - 1).cast("int"))).alias("raw"),
        F.when(at > 0, F.get(lines_col, at.cast("int"))).alias("after"),
    )
    return let(hit, build)
