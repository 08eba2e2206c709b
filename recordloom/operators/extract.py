"""Records from raw pages and text.

Two jobs: ``extract_fields`` evaluates a table of column expressions in one pass, and
``extract_nodes`` turns HTML into one row per element (the only step Spark has no
function for), on which everything else is DataFrame work.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import lists as L
from recordloom.functions.text import (
    collapse,
    first_value,
    label_value,
    lines,
    missing,
    or_empty,
    slice_after,
    strip,
)
from recordloom.functions.urls import absolute, without_fragment
from recordloom.session import short_batches

# --- fields by expression ---------------------------------------------------------------

HEADING_WITH_ID = r"(.+?)\s*\[([A-Za-z0-9]+)\]"
# The id shapes that occur in link texts.
CODE_PLAIN = r"[A-Z]{1,6}\d{4,5}"
CODE_WITH_LETTER = r"[A-Z]{1,6}\d{4,5}[A-Z]?"
LABELS = {
    "industry": "Industry",
    "topic": "Topic",
    "technical_level": "Technical Level",
    "intended_audience": "Intended Audience",
    "nvidia_technology": "NVIDIA Technology",
}
BUTTON_TEXT = ["Add to Schedule", "Register"]
# Page furniture that ends an abstract, and headings that are no titles.
ORAL_ENDS = ["\nChat\n", "\nDirectory"]
WORKSHOP_ENDS = ["\nLog in", "\nSchedule\n", "\nChat\n", "\nICLR uses"]
MENU_HEADING = "Main Navigation"
SITE_NAME = "ICLR"


def extract_fields(pages: DataFrame, spec: Mapping[str, Column]) -> DataFrame:
    """Add every field of ``spec`` (name -> expression) in one select."""
    return pages.withColumns(dict(spec))


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first element of a kind, tags and common entities removed."""
    return plain_text(F.regexp_extract(html, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(text)


def heading_fields(heading: Column) -> dict[str, Column]:
    """'Title [ID]' -> title and id; a heading without an id is all title."""
    return {
        "title": F.when(
            heading.rlike(HEADING_WITH_ID), strip(F.regexp_extract(heading, HEADING_WITH_ID, 1))
        ).otherwise(heading),
        "session_id": F.regexp_extract(heading, HEADING_WITH_ID, 2),
    }


def labelled_fields(text: Column, labels: Mapping[str, str] = LABELS) -> dict[str, Column]:
    return {name: label_value(text, label) for name, label in labels.items()}


def badge_fields(badges: Column) -> dict[str, Column]:
    return {
        "session_type": L.badge_type(badges),
        "format": L.badge_format(badges),
        "recording": L.badge_recording(badges),
    }


def takeaways(items: Column, text: Column) -> Column:
    """List items of the page, else the text block after 'Key Takeaways:'."""
    block = F.regexp_extract(
        text, r"(?s)Key Takeaways:\n(.+?)(?:\n(?:Add to Schedule|Register|Share)|\z)", 1
    )
    return L.bulleted(items, block, BUTTON_TEXT)


def oral_fields(heading: Column, people: Column, text: Column, links: Column, base: str) -> dict[str, Column]:
    """A talk page. ``links`` is array<struct<href, text>>; ``people`` the candidate headings."""
    when = r"(?i)(\w{3}\s+\d+\s+\w+)\s+([\d:]+\s*[ap]\.m\.)\s*\w+\s*[-—]\s*([\d:]+\s*[ap]\.m\.)\s*\w+"
    session = first_link(links, lambda a: F.contains(a["href"], F.lit("/session/")))
    slides = first_link(
        links,
        lambda a: F.contains(a["text"], F.lit("Slides"))
        & (F.contains(a["href"], F.lit("/attachment")) | F.contains(a["href"], F.lit("slides"))),
    )
    forum = first_link(links, lambda a: F.contains(a["href"], F.lit("openreview.net/forum")))
    return {
        "title": heading,
        "authors": or_empty(F.get(F.filter(people, lambda p: F.contains(p, F.lit("·"))), 0)),
        "session_name": or_empty(strip(session["text"])),
        "session_url": or_empty(F.concat(F.lit(base), session["href"])),
        "openreview_url": or_empty(forum["href"]),
        "slides_url": or_empty(slides["href"]),
        "date": strip(F.regexp_extract(text, when, 1)),
        "start_time": strip(F.regexp_extract(text, when, 2)),
        "end_time": strip(F.regexp_extract(text, when, 3)),
        "abstract": slice_after(text, "Abstract:", ORAL_ENDS),
    }


def workshop_fields(heading: Column, people: Column, text: Column, links: Column) -> dict[str, Column]:
    """A workshop page; organizers fall back to a text line with at least three dotted parts."""
    when = (
        r"(\w{3}, \w{3} \d+, \d{4})\s*[•·]\s*([\d:]+\s*[AP]M)\s*[-–]\s*"
        r"([\d:]+\s*[AP]M)\s*(\w+)"
    )
    dotted = F.filter(F.split(text, "\n"), lambda x: F.size(F.split(x, "·")) >= 3)
    project = first_link(links, lambda a: F.contains(a["text"], F.lit("Project Page")))
    return {
        "title": heading,
        "date": strip(F.regexp_extract(text, when, 1)),
        "start_time": strip(F.regexp_extract(text, when, 2)),
        "end_time": strip(F.regexp_extract(text, when, 3)),
        "timezone": strip(F.regexp_extract(text, when, 4)),
        "organizers": first_value(
            F.get(F.filter(people, lambda p: F.contains(p, F.lit("·"))), 0), strip(F.get(dotted, 0))
        ),
        "abstract": slice_after(text, "Abstract\n", WORKSHOP_ENDS),
        "project_url": or_empty(project["href"]),
    }


def first_link(links: Column, test) -> Column:
    return F.get(F.filter(links, test), 0)


def talk_fields(texts: Column, title: Column, calendar: Mapping[str, Column]) -> dict[str, Column]:
    """An invited talk from the texts of its page in order: lines after the label and the title."""
    label = F.array_position(
        F.transform(texts, lambda t: t.rlike(r"(?i)^(INVITED|KEYNOTE)\s+TALK$")), F.lit(True)
    )
    heading = F.array_position(texts, title)

    def after(at: Column, step: int) -> Column:
        return or_empty(F.when(at > 0, F.get(texts, (at - 1 + step).cast("int"))))

    return {
        "detail_title": first_value(title, calendar["title"]),
        "date_line": after(label, 1),
        "room": after(label, 2),
        "speaker": F.when(~missing(title), after(heading, 1)).otherwise(""),
    }


def session_fields(texts: Column) -> dict[str, Column]:
    """A group session: its time line is the first text with weekday, day, month and a dash."""
    pattern = r"^(Mon|Tue|Wed|Thu|Fri)\s+\d+\s+\w+\s+.+(—|--).+"
    return {"time_line": or_empty(collapse(F.get(F.filter(texts, lambda t: t.rlike(pattern)), 0)))}


def entry_fields(url: Column, classes: Column, end_note: Column, path: str) -> dict[str, Column]:
    """A calendar entry: kind and id from the URL path, room from the classes, bare end time."""
    bare = without_fragment(url)
    pattern = path + r"([a-z-]+)/(\d+)"
    return {
        "url": bare,
        "kind": F.regexp_extract(bare, pattern, 1),
        "id": F.regexp_extract(bare, pattern, 2),
        "room": L.room_of(classes),
        "end_raw": F.regexp_replace(F.regexp_replace(end_note, r"^\(ends\s*", ""), r"\)$", ""),
    }


# --- links in text ------------------------------------------------------------------------


def anchors(html: Column) -> Column:
    """array<struct<href, text>> of all anchors, texts without tags."""
    raw = F.regexp_extract_all(html, F.lit(r"(?s)(<a\s[^>]*>.*?</a>)"), F.lit(1))
    return F.transform(
        raw,
        lambda a: F.struct(
            F.regexp_extract(a, r'href="([^"]*)"', 1).alias("href"), plain_text(a).alias("text")
        ),
    )


def coded_links(pages: DataFrame, key: str, html: str, code: str = CODE_WITH_LETTER) -> DataFrame:
    """(key, pos, session_id, title, url) of anchors whose text carries an id in brackets."""
    links = pages.select(key, F.posexplode(anchors(F.col(html))).alias("pos", "a"))
    text = F.col("a.text")
    return links.filter(text.rlike(rf"\[{code}\]")).select(
        key,
        "pos",
        F.regexp_extract(text, rf"\[({code})\]", 1).alias("session_id"),
        strip(F.regexp_replace(text, rf"(?s)^(.*?)\[{code}\](.*)$", "$1$2")).alias("title"),
        F.col("a.href").alias("url"),
    )


def link_targets(pages: DataFrame, key: str, html: str, href_pattern: str, base: str) -> DataFrame:
    """(key, pos, text, url) of anchors whose target fits a pattern, targets made absolute."""
    links = pages.select(key, F.posexplode(anchors(F.col(html))).alias("pos", "a"))
    return links.filter(F.col("a.href").rlike(href_pattern)).select(
        key, "pos", F.col("a.text").alias("text"), absolute(F.col("a.href"), base).alias("url")
    )


def name_refs(snapshots: DataFrame, key: str, text: str) -> DataFrame:
    """(name, ref) pairs of snapshot lines ``- link "name" [ref=e1]``; the last one of a name wins."""
    pattern = r'- link "([^"]+)" \[ref=([^\]]+)\]'
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("ref"),
    )
    found = snapshots.select(key, F.posexplode(pairs).alias("pos", "p"))
    return found.groupBy(F.col("p.name").alias("name")).agg(
        F.max_by("p.ref", F.struct(key, "pos")).alias("ref")
    )


def facet_labels(pages: DataFrame, html: str, prefix: str) -> DataFrame:
    """Distinct non-empty names of filter labels, without their prefix."""
    names = F.regexp_extract_all(html, F.lit(rf'<label for="{re.escape(prefix)}([^"]*)"'), F.lit(1))
    label = pages.select(F.explode(names).alias("label"))
    return label.select(strip(F.col("label")).alias("label")).filter("label <> ''").distinct()


# --- nodes --------------------------------------------------------------------------------

NODE_SCHEMA = (
    "page_id long, pos int, end_pos int, depth int, tag string, classes array<string>, "
    "attrs map<string,string>, href string, text string"
)
_NODE_TYPES = {
    "pos": pa.int32(), "end_pos": pa.int32(), "depth": pa.int32(), "tag": pa.string(), "classes": pa.list_(pa.string()),
    "attrs": pa.map_(pa.string(), pa.string()), "href": pa.string(), "text": pa.string(),
}
NODES_PER_BATCH = 5_000
#: Combinations of a tag and classes whose kinds a task remembers.
KNOWN_SHAPES = 10_000
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style"))
# plain markup: tags with quoted attributes and text; whose tags' content is text, declarations, comments and the like are not
_TOKEN = re.compile(r'(</([a-zA-Z][a-zA-Z0-9]*)>|<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9-]*="[^"<>&]*")*)>|[^<]+)')
_ATTR = re.compile(r'([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext svg math".split())


@dataclass(frozen=True)
class Container:
    """What makes an element a container: its tag, classes it has, its class text, an attribute it has."""

    tag: str | None = None
    has: tuple[str, ...] = ()
    classes: str | None = None
    attr: str | None = None

    def fits(self, tag: str, attrs: Mapping[str, str]) -> bool:
        text = attrs.get("class", "")
        return (
            (self.tag is None or tag == self.tag)
            and all(c in text.split() for c in self.has)
            and (self.classes is None or re.search(self.classes, text) is not None)
            and (self.attr is None or self.attr in attrs)
        )


@dataclass(frozen=True)
class First:
    """A value of the first element of a group that fits; null without one.

    A group is the elements of a page whose nearest containers ``inside`` are the same ones (or
    are missing alike); without names it is the page. ``within`` and ``outside`` name containers
    that the element is and is not in, ``text`` is what its stripped text is, whatever its case.
    ``value`` is text, href, pos, end_pos, depth, classes, or the name of an attribute or of another column.
    """

    inside: tuple[str, ...]
    fits: Container
    value: str = "text"
    within: tuple[str, ...] = ()
    outside: str | None = None
    text: str | None = None


@dataclass(frozen=True)
class All(First):
    """The same of all elements of a group that fit, in order: array<struct> of the ``values``."""

    values: tuple[str, ...] = ("pos", "text")


@dataclass(frozen=True)
class Above:
    """The value of the column ``first`` on the last container so far that has one."""

    first: str


@dataclass(frozen=True)
class After:
    """The text of the element that follows the one of the column ``first``, next to it."""

    first: str


Wanted = Mapping[str, "Sequence[Container] | First | Above | After"]


class _Rules:
    """The containers and columns wanted, and which elements fit them (remembered by tag and classes)."""

    def __init__(self, wanted: Wanted | None) -> None:
        wanted = dict(wanted or {})
        self.kinds = {n: w for n, w in wanted.items() if not isinstance(w, (First, Above, After))}
        self.columns = {n: w for n, w in wanted.items() if n not in self.kinds}
        self.sought = {n: w for n, w in self.columns.items() if isinstance(w, First)}
        every = [k for kinds in self.kinds.values() for k in kinds] + [w.fits for w in self.sought.values()]
        self.attrs = sorted({k.attr for k in every if k.attr is not None})
        self.known: dict[tuple, tuple] = {}

    def fits(self, tag: str, attrs: Mapping[str, str]) -> tuple[list[str], list[str]]:
        """Names of the containers that an element is, and of the columns it fits."""
        shape = (tag, attrs.get("class", ""), *[a in attrs for a in self.attrs])
        if (names := self.known.get(shape)) is None:
            if len(self.known) >= KNOWN_SHAPES:
                self.known.clear()
            names = self.known[shape] = (
                [n for n, kinds in self.kinds.items() if any(k.fits(tag, attrs) for k in kinds)],
                [n for n, w in self.sought.items() if w.fits.fits(tag, attrs)],
            )
        return names

    def arrow_type(self, value: str) -> pa.DataType:
        if value in self.kinds:
            return pa.int32()
        match self.columns.get(value):
            case All(values=values):
                return pa.list_(pa.struct([(v, self.arrow_type(v)) for v in values]))
            case First(value=inner) | Above(first=inner):
                return self.arrow_type(inner)
        return _NODE_TYPES.get(value, pa.string())

    def spark_type(self, value: str) -> str:
        match self.columns.get(value):
            case All(values=values):
                return f"array<struct<{', '.join(f'{v}: {self.spark_type(v)}' for v in values)}>>"
            case First(value=inner) | Above(first=inner):
                return self.spark_type(inner)
        if value in self.kinds or value in ("pos", "end_pos", "depth"):
            return "int"
        return {"classes": "array<string>", "attrs": "map<string,string>"}.get(value, "string")


class _Outline(HTMLParser):
    """Lists the elements of one page in document order with the text below each.

    Each node knows the place of the nearest container of every kind that it is in, or is,
    however they nest (``at``), and which columns it fits; ``value`` gives a column on a node.
    """

    def __init__(self, rules: _Rules) -> None:
        super().__init__(convert_charrefs=True)
        self.rules = rules
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.found: dict[tuple, list[dict]] = {}
        self.above: dict[str, tuple[list[int], list]] = {}

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        pos = len(self.nodes)
        own, fits = self.rules.fits(tag, attrs)
        at = self.open[-1]["at"] if self.open else {}
        if own:
            at = {**at, **dict.fromkeys(own, pos)}
        node = {"pos": pos, "end_pos": pos, "depth": len(self.open), "tag": tag, "attrs": attrs, "text": [], "at": at, "fits": fits}
        self.nodes.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                self._close(i)
                return

    def _close(self, level):
        for node in self.open[level:]:
            node["end_pos"] = len(self.nodes) - 1
        # text moves up once per element, when the element ends
        for node in reversed(self.open[level:]):
            node["text"] = "".join(node["text"])
            above = self.open[node["depth"] - 1] if node["depth"] else None
            if above is not None and node["tag"] not in _SILENT:
                above["text"].append(node["text"])
        del self.open[level:]

    def handle_data(self, data):
        if self.open:
            self.open[-1]["text"].append(data)

    def _read(self, html: str) -> None:
        """Feed the parser; plain markup, which needs none of its care, goes to the same handlers by one match a token."""
        tokens = _TOKEN.findall(html)
        if sum([len(t[0]) for t in tokens]) < len(html) or not _RAW.isdisjoint([t[2].lower() for t in tokens]):
            self.feed(html)
            self.close()
            return
        for whole, ended, tag, attrs in tokens:
            if tag:
                self.handle_starttag(tag.lower(), [(k.lower(), v) for k, v in _ATTR.findall(attrs)] if attrs else ())
            elif ended:
                self.handle_endtag(ended.lower())
            else:
                self.handle_data(unescape(whole) if "&" in whole else whole)

    def outline(self, html: str) -> list[dict]:
        self._read(html)
        self._close(0)
        for node in self.nodes:
            if isinstance(node["text"], list):
                node["text"] = "".join(node["text"])
            for name in node["fits"]:
                w, at = self.rules.sought[name], node["at"]
                if all([c in at for c in w.within]) and (w.outside is None or w.outside not in at):
                    if w.text is None or node["text"].strip().lower() == w.text:
                        self.found.setdefault((name, *map(at.get, w.inside)), []).append(node)
        for name, w in self.rules.columns.items():
            if isinstance(w, Above):
                (inside,) = self.rules.sought[w.first].inside
                values = [(n["pos"], self.value(n, w.first)) for n in self.nodes if n["at"].get(inside) == n["pos"]]
                self.above[name] = tuple(zip(*[v for v in values if v[1] is not None])) or ((), ())
        return self.nodes

    def value(self, node: dict, name: str):
        """A column, a property or an attribute of a node."""
        w = self.rules.columns.get(name)
        if w is None:
            if name in self.rules.kinds:
                return node["at"].get(name)
            if name in node:
                return node[name]
            return node["attrs"].get("class", "").split() if name == "classes" else node["attrs"].get(name)
        if isinstance(w, Above):
            places, values = self.above[name]
            i = bisect_right(places, node["pos"])
            return values[i - 1] if i else None
        if isinstance(w, After):
            hit = self.found.get((w.first,))
            at = hit[0]["end_pos"] + 1 if hit else len(self.nodes)
            return self.nodes[at]["text"] if at < len(self.nodes) and self.nodes[at]["depth"] == hit[0]["depth"] else None
        hits = self.found.get((name, *map(node["at"].get, w.inside)), ())
        if isinstance(w, All):
            return [{v: self.value(hit, v) for v in w.values} for hit in hits]
        return self.value(hits[0], w.value) if hits else None


def _key_type(pages: DataFrame, key: str) -> str:
    """Whole-number keys of pages stay such, all others are text."""
    return "long" if dict(pages.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else "string"


def extract_nodes(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    tags: Sequence[str] | None = None,
    containers: Wanted | None = None,
    groups: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """One row per element: place, end of its subtree, depth, tag, classes, attributes, text.

    ``end_pos`` is the place of the last element below it, so "inside" is a range test. Outer
    elements repeat the text of inner ones; name the ``tags`` wanted to leave the others
    inside the task (places count all elements all the same). For every name in ``containers``
    there is a column with the place of the nearest element around a node (or the node itself)
    that fits one of its kinds, null outside, or the value of a ``First``, ``All``, ``Above`` or
    ``After``; the parser knows them, so no window and no shuffle is needed. With ``groups`` only the first
    element of every group comes out, a group being the elements that are in the same nearest containers of all names given.
    """
    groups = None if groups is None else [tuple(g) for g in groups]
    wanted = None if tags is None else frozenset(tags)

    def chosen(nodes: list[dict]) -> list[dict]:
        if wanted is not None:
            nodes = [n for n in nodes if n["tag"] in wanted]
        if groups is None:
            return nodes
        seen, first = set(), []
        for n in nodes:
            at = n["at"]
            places = {(i, *[at[c] for c in g]) for i, g in enumerate(groups) if all([c in at for c in g])}
            if not places <= seen:
                seen |= places
                first.append(n)
        return first

    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")[1:]] + list(containers or {})
    return _parsed(pages.select(F.col(key), F.col(html)), key, html, containers, names, chosen)


def extract_pages(
    pages: DataFrame, key: str = "page_id", html: str = "html", containers: Wanted | None = None, names: Sequence[str] = ()
) -> DataFrame:
    """``pages`` (without the html) and the columns ``names`` of ``containers`` on the first element of each; null without one."""
    return _parsed(pages, key, html, containers, names, lambda nodes: nodes[:1] or [None])


def _parsed(
    pages: DataFrame, key: str, html: str, containers: Wanted | None, names: Sequence[str], chosen: Callable[[list[dict]], list]
) -> DataFrame:
    """(page_id, the other columns of ``pages``, ``names``) of the chosen nodes of every page."""
    rules = _Rules(containers)
    rest = [c for c in pages.columns if c not in (key, html)]
    id_type = _key_type(pages, key)
    types = {name: rules.arrow_type(name) for name in names}
    schema = ", ".join([
        f"page_id {id_type}",
        *[f"`{c}` {t}" for c, t in pages.select(rest).dtypes],
        *[f"{name} {rules.spark_type(name)}" for name in names],
    ])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = [], {name: [] for name in names}

            def made() -> pa.RecordBatch:
                kept = batch.select(["page_id", *rest]).take(pa.array(rows, pa.int32()))
                values = [pa.array([list(v.items()) if v is not None else v for v in c] if name == "attrs" else c, types[name]) for name, c in columns.items()]
                return pa.RecordBatch.from_arrays([*kept.columns, *values], ["page_id", *rest, *names])

            for row, text in enumerate(batch.column("_html")):
                page = _Outline(rules)
                for node in chosen(page.outline(text.as_py() or "")):
                    rows.append(row)
                    for name, column in columns.items():
                        column.append(None if node is None else page.value(node, name))
                if len(rows) > NODES_PER_BATCH:
                    yield made()
                    rows, columns = [], {name: [] for name in names}
            if rows:
                yield made()

    given = short_batches(pages).select(F.col(key).cast(id_type).alias("page_id"), *rest, F.col(html).alias("_html"))
    return given.mapInArrow(parse, schema)


def has_class(name: str, classes: str = "classes") -> Column:
    return F.array_contains(classes, name)


# --- whole pages ----------------------------------------------------------------------------

_BLOCK_END = r"(?i)<br\s*/?>|</(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|main)>"


def page_text(html: Column) -> Column:
    """Visible text with a line break after every block element, lines stripped, no empty ones."""
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1>", "")
    return F.array_join(lines(plain_text(F.regexp_replace(body, _BLOCK_END, "\n"))), "\n")


def text_sequence(html: Column) -> Column:
    """The texts between tags in order, stripped, no empty ones."""
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "")
    return F.filter(F.transform(F.split(body, "<[^>]*>"), plain_text), lambda t: t != "")


def tag_texts(html: Column, tag: str) -> Column:
    """Texts of all elements of a kind that does not nest."""
    found = F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, plain_text)


def oral_page(html: Column, base: str, skip: str = SITE_NAME) -> dict[str, Column]:
    """All fields of a talk page. The title is the first h2 that is not site furniture."""
    title = F.filter(
        tag_texts(html, "h2"), lambda t: (t != "") & (t != MENU_HEADING) & ~F.contains(t, F.lit(skip))
    )
    return oral_fields(or_empty(F.get(title, 0)), tag_texts(html, "h3"), page_text(html), anchors(html), base)


def workshop_page(html: Column) -> dict[str, Column]:
    """All fields of a workshop page."""
    return workshop_fields(tag_text(html, "h1"), tag_texts(html, "h3"), page_text(html), anchors(html))


def session_details(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Detailed session records: heading, badges, abstract, speakers, labels, takeaways.

    Elements are found on the node table, labelled values in the visible text. Only the few
    extracted columns of the text side meet the node side, by page.
    """
    text = page_text(F.col(html))
    block = F.regexp_extract(
        text, r"(?s)Key Takeaways:\n(.+?)(?:\n(?:Add to Schedule|Register|Share)|\z)", 1
    )
    from_text = pages.select(
        F.col(key).cast(_key_type(pages, key)).alias("page_id"),
        tag_text(F.col(html), "h1").alias("heading"),
        block.alias("block"),
        *[value.alias(name) for name, value in labelled_fields(text).items()],
    )
    nodes = extract_nodes(pages, key, html).withColumn("text", strip("text"))
    in_page = Window.partitionBy("page_id")
    is_label = F.col("tag").isin("span", "b") & F.contains("text", F.lit("Key Takeaways:"))
    # the list belongs to the element around the label: the last one opened one level above it
    nodes = nodes.withColumn("label_at", F.min(F.when(is_label, F.col("pos"))).over(in_page))
    nodes = nodes.withColumn("label_depth", F.max(F.when(F.col("pos") == F.col("label_at"), F.col("depth"))).over(in_page))
    around = (F.col("pos") < F.col("label_at")) & (F.col("end_pos") >= F.col("label_at"))
    is_parent = around & (F.col("depth") == F.col("label_depth") - 1)
    nodes = nodes.withColumns(
        {
            "parent_at": F.max(F.when(is_parent, F.col("pos"))).over(in_page),
            "parent_end": F.max(F.when(is_parent, F.col("end_pos"))).over(in_page),
        }
    )
    inside = F.col("pos").between(F.col("parent_at"), F.col("parent_end"))
    nodes = nodes.withColumns(
        {
            "list_at": F.min(F.when(inside & (F.col("tag") == "ul"), F.col("pos"))).over(in_page),
        }
    )
    nodes = nodes.withColumn("list_end", F.max(F.when(F.col("pos") == F.col("list_at"), F.col("end_pos"))).over(in_page))

    def texts(condition: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", "text"))))
        return F.transform(found, lambda n: n["text"])

    is_abstract = (F.col("tag") == "div") & has_class("abstract")
    is_item = (F.col("tag") == "li") & F.col("pos").between(F.col("list_at"), F.col("list_end"))
    from_nodes = nodes.groupBy("page_id").agg(
        texts(has_class("badge")).alias("badges"),
        or_empty(F.min_by(F.when(is_abstract, F.col("text")), F.when(is_abstract, F.col("pos")))).alias("abstract"),
        texts((F.col("tag") == "span") & has_class("p--medium")).alias("speaker_lines"),
        texts(is_item).alias("items"),
    )
    joined = from_text.join(from_nodes, "page_id", "left")
    none = F.array().cast("array<string>")
    fields = {
        **heading_fields(F.col("heading")),
        **badge_fields(F.coalesce("badges", none)),
        "abstract": or_empty(F.col("abstract")),
        "key_takeaways": L.bulleted(F.coalesce("items", none), F.col("block"), BUTTON_TEXT),
        "speakers": L.speaker_structs(F.coalesce("speaker_lines", none)),
    }
    return extract_fields(joined, fields).drop("heading", "block", "badges", "speaker_lines", "items")


def detail_pages(pages: DataFrame, key: str = "page_id", html: str = "html", kind: str = "kind") -> DataFrame:
    """The ``detail`` struct of calendar entries, by the kind of page.

    An invited talk is read from its text sequence, a group session from its heading, time
    line and cards. Pages without a title come out with '' throughout.
    """
    texts = F.transform(text_sequence(F.col(html)), collapse)
    talk_title = collapse(tag_text(F.col(html), "h1"))
    fields = talk_fields(F.col("texts"), F.col("talk_title"), {"title": F.lit("")})
    heads = pages.select(
        F.col(key).cast(_key_type(pages, key)).alias("page_id"),
        F.col(kind).alias("kind"),
        F.col(html).alias("html"),
        texts.alias("texts"),
        talk_title.alias("talk_title"),
        collapse(tag_text(F.col(html), "h2")).alias("session_title"),
        collapse(tag_text(F.col(html), "h5")).alias("session_room"),
    )
    heads = extract_fields(heads, {**fields, **session_fields(F.col("texts"))}).drop("texts")
    joined = _abstract_and_cards(extract_pages(heads, "page_id", "html", CARDS, ("after_head", "cards")))
    talk = F.col("kind") == "invited-talk"
    detail = F.struct(
        F.when(talk, F.col("talk_title")).otherwise(F.col("session_title")).alias("title"),
        F.when(talk, F.col("room")).otherwise(F.col("session_room")).alias("room"),
        F.when(talk, F.col("date_line")).otherwise("").alias("date_line"),
        F.when(talk, "").otherwise(F.col("time_line")).alias("time_line"),
        F.when(talk, F.col("speaker")).otherwise("").alias("speaker"),
        F.when(talk, or_empty(F.col("abstract"))).otherwise("").alias("abstract"),
        F.when(~talk, F.col("papers")).alias("papers"),
    )
    return joined.select("page_id", "kind", detail.alias("detail"))


_CARD = Container("div", ("track-schedule-card",))
CARDS = {
    "card_at": [_CARD],
    "title_at": [Container("h5")],
    "part_at": First(("card_at",), Container(), "pos"),
    "title": First(("card_at",), Container("h5")),
    "url": First(("card_at",), Container("a"), "href", within=("title_at",)),
    "authors": First(("card_at",), Container("p")),
    "abstract": First(("card_at",), Container(has=("abstract",))),
    "cards": All((), _CARD, values=("title", "url", "authors", "abstract")),
    "head": First((), Container("h3"), "pos", text="abstract"),
    "after_head": After("head"),
}
#: For ``extract_nodes``: the rows that ``session_cards`` reads.
CARD_ROWS = [("card_at",)]


def _card(of: Callable[[str], Column]) -> dict[str, Column]:
    """The columns of a talk card from what the parser found."""
    url = or_empty(without_fragment(of("url")))
    return {c: url if c == "url" else or_empty(collapse(of(c))) for c in ("title", "url", "authors", "abstract")}


def page_parts(nodes: DataFrame) -> DataFrame:
    """Per page (nodes with CARDS) one row per talk card (``card_at`` is its place) and one for all the rest.

    ``after_head`` is the text of the element after the page's 'Abstract' heading, on all its rows.
    """
    parts = nodes.filter(F.col("pos") == F.col("part_at"))
    found = [c.alias(n) for n, c in _card(F.col).items()]
    return parts.select("page_id", "card_at", *found, or_empty(collapse(F.col("after_head"))).alias("after_head"))


def session_cards(nodes: DataFrame) -> DataFrame:
    """Talk cards of a group session page: title, url, authors, abstract per card."""
    cards = page_parts(nodes).filter(F.col("card_at").isNotNull() & (F.col("title") != ""))
    return cards.withColumnRenamed("card_at", "pos").drop("after_head")


def _abstract_and_cards(pages: DataFrame) -> DataFrame:
    cards = F.transform("cards", lambda c: F.struct(*[v.alias(n) for n, v in _card(lambda name: c[name]).items()]))
    return pages.withColumns(
        {"abstract": or_empty(collapse(F.col("after_head"))), "papers": F.filter(cards, lambda c: c["title"] != "")}
    ).drop("cards", "after_head")
