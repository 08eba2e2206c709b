"""Text columns: trimming, missing values, cleaning, label and marker extraction."""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.session import short_batches

# Every Unicode whitespace character.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column | str) -> Column:
    """Remove every kind of whitespace at both ends (Spark's ``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse(c: Column) -> Column:
    """Runs of whitespace become one space; ends are stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def missing(c: Column) -> Column:
    """Null and '' are missing; a blank-only string is a value."""
    return F.coalesce(c, F.lit("")) == ""


def empty(c: Column) -> Column:
    """Null and zero-length arrays."""
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_value(*cols: Column | str) -> Column:
    """The first argument that is not missing, else ''. Strings are literals."""
    as_cols = [c if isinstance(c, Column) else F.lit(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in as_cols], F.lit(""))


def contains_ci(c: Column, needle: str) -> Column:
    """Case-insensitive substring test, false for null."""
    return F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))


def lines(c: Column) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def clip(c: Column, limit: int) -> Column:
    """Cut at ``limit`` characters and add '...' only when something was cut."""
    c = or_empty(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def label_value(c: Column, label: str) -> Column:
    """Text after ``label:`` up to the end of the line, '' when the label is absent."""
    return strip(F.regexp_extract(c, label + r":\s*([^\n]+)", 1))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body`` (so a long expression is not repeated)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slice_after(c: Column, start: str, ends: list[str]) -> Column:
    """Text after the first ``start`` up to the earliest end marker, '' when ``start`` is absent.

    A marker whose first occurrence opens the slice does not end it.
    """

    def cut(rest: Column) -> Column:
        stops = F.filter(F.array(*[F.instr(rest, F.lit(e)) for e in ends]), lambda p: p > 1)
        return strip(F.coalesce(F.substr(rest, F.lit(1), F.array_min(stops) - 1), rest))

    at = F.instr(c, F.lit(start))
    return F.when(at > 0, let(strip(F.substr(c, at + len(start))), cut)).otherwise("")


# --- Unicode cleaning -------------------------------------------------------------------
# One-character replacements shared by every variant.
SINGLE_QUOTES = "\u2018\u2019"
DOUBLE_QUOTES = "\u201c\u201d"
DASHES = "\u2013\u2014"
NO_BREAK_SPACE = "\u00a0"
ZERO_WIDTH_SPACE = "\u200b"
ELLIPSIS = "\u2026"
LINE_SEPARATORS = "\u2028\u2029"
DOT_OPERATOR = "\u22c5"

VARIANTS = ("full", "no_line_separators", "collapsed")


def replace_marks(c: Column, variant: str = "full") -> Column:
    """The character map alone, without NFKC."""
    source = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + NO_BREAK_SPACE
    target = "''" + '""' + "--" + " "
    if variant != "no_line_separators":
        source, target = source + LINE_SEPARATORS, target + "  "
    # translate() drops characters that have no partner: the zero-width space goes last
    out = F.translate(c, source + ZERO_WIDTH_SPACE, target)
    out = F.replace(out, F.lit(ELLIPSIS), F.lit("..."))
    if variant == "collapsed":
        out = F.replace(out, F.lit(DOT_OPERATOR), F.lit(" * "))
    return out


def _tidy(c: Column) -> Column:
    """Extra steps of the collapsed variant: drop carriage returns, real or spelled out."""
    return collapse(F.replace(F.regexp_replace(c, r"(?U)\bx000D\b", ""), F.lit("\r"), F.lit("")))


@F.arrow_udf(T.StringType())
def _nfkc(s: pa.Array) -> pa.Array:
    # Arrow's own normaliser decomposes without composing again (checked with the installed version)
    normal = unicodedata.is_normalized
    texts = (x.as_py() for x in s)
    return pa.array((x if x is None or normal("NFKC", x) else unicodedata.normalize("NFKC", x) for x in texts), pa.string())


def _nfkc_value(value):
    if isinstance(value, str):
        return unicodedata.normalize("NFKC", value)
    if isinstance(value, list):
        return [_nfkc_value(v) for v in value]
    if isinstance(value, dict):
        return {k: _nfkc_value(v) for k, v in value.items()}
    return value


@F.arrow_udf(T.StringType())
def _nfkc_json(s: pa.Array) -> pa.Array:
    # value by value, so that the texts of a batch are not all held as objects
    def clean(x: pa.Scalar) -> str | None:
        return json.dumps(_nfkc_value(json.loads(x.as_py())), ensure_ascii=False) if x.is_valid else None

    return pa.array(map(clean, s), pa.string())


_NON_ASCII = r"[^\x00-\x7F]"


def clean_text(c: Column, variant: str = "full") -> Column:
    """Map typographic marks, then NFKC; only text beyond ASCII is sent to Python."""
    mapped = replace_marks(c, variant)
    beyond = F.when(mapped.rlike(_NON_ASCII), mapped)
    out = F.coalesce(_nfkc(beyond), mapped)
    return _tidy(out) if variant == "collapsed" else out


def _map_strings(c: Column, dtype: T.DataType, fn) -> Column:
    """Rebuild a nested column with ``fn`` applied to every string value (map keys stay)."""
    if isinstance(dtype, T.StringType):
        return fn(c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _map_strings(x, dtype.elementType, fn))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda k, v: _map_strings(v, dtype.valueType, fn))
    if isinstance(dtype, T.StructType):
        rebuilt = F.struct(
            *[_map_strings(c[f.name], f.dataType, fn).alias(f.name) for f in dtype.fields]
        )
        return F.when(c.isNotNull(), rebuilt)
    return c


def _has_string(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_string(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_string(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_string(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.StringType)


def clean_frame(df: DataFrame, variant: str = "full") -> DataFrame:
    """Clean every string of every column, at any depth."""
    short_batches(df)
    out = []
    for field in df.schema.fields:
        c, dtype = F.col(f"`{field.name}`"), field.dataType
        if isinstance(dtype, T.StringType):
            c = clean_text(c, variant)
        elif _has_string(dtype):
            mapped = _map_strings(c, dtype, lambda x: replace_marks(x, variant))
            as_json = F.to_json(mapped, {"ignoreNullFields": "false"})
            beyond = F.when(as_json.rlike(_NON_ASCII), as_json)
            c = F.coalesce(F.from_json(_nfkc_json(beyond), dtype), mapped)
            if variant == "collapsed":
                c = _map_strings(c, dtype, _tidy)
        out.append(c.alias(field.name))
    return df.select(*out)
