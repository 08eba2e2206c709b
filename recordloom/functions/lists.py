"""Columns over lists of text: people, badges, lookups by position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import or_empty, strip


def split_people(c: Column) -> Column:
    """'A * B,* * C' -> [A, B, C]: split on stars, strip commas and stars, drop empties."""
    cleaned = F.transform(
        F.split(or_empty(c), r"\s*\*\s*"),
        lambda p: strip(
            F.regexp_replace(F.regexp_replace(strip(p), r"^,+|,+$", ""), r"^\*+|\*+$", "")
        ),
    )
    return F.filter(cleaned, lambda p: p != "")


def speaker_structs(lines_col: Column) -> Column:
    """'name | title | company' lines -> array of struct; lines without a bar are no speakers."""

    def one(line: Column) -> Column:
        parts = F.transform(F.split(line, r" \| "), strip)
        return F.struct(
            parts[0].alias("name"),
            F.when(F.size(parts) >= 3, parts[1]).otherwise("").alias("title"),
            F.element_at(parts, -1).alias("company"),
        )

    stripped = F.transform(lines_col, strip)
    return F.transform(F.filter(stripped, lambda x: F.contains(x, F.lit(" | "))), one)


def badge_type(badges: Column) -> Column:
    return F.coalesce(F.get(badges, 0), F.lit(""))


def badge_format(badges: Column) -> Column:
    here = F.array_contains(badges, "In-Person")
    remote = F.array_contains(badges, "Virtual")
    return (
        F.when(here & remote, "Both").when(here, "In-Person").when(remote, "Virtual").otherwise("")
    )


def badge_recording(badges: Column) -> Column:
    unrecorded = F.exists(badges, lambda b: F.contains(F.lower(b), F.lit("not record")))
    return F.when(unrecorded, "No").otherwise("Yes")


def title_case(c: Column) -> Column:
    """Every letter after something that is no letter in upper case, all others in lower case: 'q&a panel' -> 'Q&A Panel'."""
    # a blank, which is taken out again, begins a word where other marks stand before a letter
    parted = F.regexp_replace(c, r"([^\p{Lu}\p{Ll}\p{Lt} ])(?=[\p{Lu}\p{Ll}\p{Lt}])", "$1\x00 ")
    return F.replace(F.initcap(parted), F.lit("\x00 "), F.lit(""))


def class_type(classes: Column, header: Column | None = None) -> Column:
    """Event type: a header text wins, else the first telling class in title case, else 'Event'."""
    telling = F.filter(
        classes, lambda c: ~c.isin("eventsession", "pad") & ~F.startswith(c, F.lit("room-"))
    )
    from_class = title_case(F.replace(F.get(telling, 0), F.lit("-"), F.lit(" ")))
    if header is None:
        return F.coalesce(from_class, F.lit("Event"))
    text = F.regexp_replace(strip(header), r":+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), from_class, F.lit("Event"))


def room_of(classes: Column) -> Column:
    """'room-grand-hall-1' among the classes -> 'Grand Hall 1'."""
    room = F.get(F.filter(classes, lambda c: F.startswith(c, F.lit("room-"))), 0)
    words = F.transform(
        F.split(F.regexp_replace(room, "^room-", ""), "-"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))),
    )
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def bulleted(dom_items: Column, block: Column, stop_words: list[str]) -> Column:
    """List items from the page, else from a text block split on line starts with bullets."""
    kept = F.filter(F.transform(dom_items, strip), lambda x: x != "")
    fallback = F.filter(
        F.transform(F.split(block, r"\n[•*\-]?\s*"), strip),
        lambda x: (x != "") & ~F.exists(
            F.array(*[F.lit(w) for w in stop_words]), lambda w: F.contains(x, w)
        ),
    )
    return F.when(F.size(kept) > 0, kept).otherwise(F.coalesce(fallback, F.array().cast("array<string>")))


def people_text(speakers_json: Column) -> Column:
    """JSON list of people -> 'name (company); ...', '' when it is not readable."""
    parsed = F.from_json(speakers_json, "array<struct<name:string,company:string>>")
    shown = F.transform(
        parsed, lambda s: F.concat(or_empty(s["name"]), F.lit(" ("), or_empty(s["company"]), F.lit(")"))
    )
    return or_empty(F.array_join(shown, "; "))


def takeaways_text(c: Column) -> Column:
    """JSON list of text -> ' | ' join; any other text stays as it is."""
    parsed = F.from_json(F.when(c.rlike(r"^\s*\["), c), "array<string>")
    return F.coalesce(F.array_join(parsed, " | "), c, F.lit(""))
