"""Snapshot diff, patch, merge, lookup and reference checks, all as keyed joins.

The side that brings new values is reduced to one row per key first, by an aggregate that
merges copies before the shuffle. Joins whose other side may repeat a key many times go
through ``skew_join``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import empty, missing, strip
from recordloom.operators.scale import first_per_key, last_per_key, skew_join


def _last(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key of the side that brings values: the last by ``order``, as in a table
    written row after row. Rows that ``order`` does not part go by their other columns."""
    rest = [c for c in df.columns if c != key and c not in order]
    return last_per_key(df, [key], [*order, *rest]).drop(*[c for c in order if c.startswith("_")])


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key is not done yet; missing keys on the done side count for nothing."""
    keys = done.filter(F.col(key).isNotNull()).select(key)
    if dict(done.dtypes)[key] == "string":
        keys = keys.filter(~missing(F.col(key)))
    return inputs.join(keys.distinct(), key, "left_anti")


def named_only(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on the list of names. A frequent key is dealt over many tasks if the list is long."""
    return skew_join(df, names.select(key).distinct(), [key], df.columns, "left_semi")


def snapshot_diff(
    old: DataFrame,
    new: DataFrame,
    key: str,
    compare: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key with ``change`` in added, removed, common (and changed, on request).

    The key is unique on both sides, or ``order`` says which row of a key is its first and
    the others are dropped before the join. By default only keys count; with ``compare`` a
    common row whose listed columns differ is 'changed'. Columns come as ``old_*`` and
    ``new_*``.
    """
    if order is not None:
        old, new = first_per_key(old, [key], order), first_per_key(new, [key], order)
    rest = [c for c in new.columns if c != key]
    a = old.select(key, F.lit(True).alias("_old"), *[F.col(c).alias(f"old_{c}") for c in rest])
    b = new.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"new_{c}") for c in rest])
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
    if compare:
        same = F.lit(True)
        for c in compare:
            same = same & F.equal_null(F.col(f"old_{c}"), F.col(f"new_{c}"))
        change = change.when(~same, "changed")
    joined = a.join(b, key, "full_outer")
    return joined.withColumn("change", change.otherwise("common")).drop("_old", "_new")


def diff_stats(diff: DataFrame) -> DataFrame:
    """One row: previous and current counts, net change, added, removed, in common."""
    added, removed = F.col("change") == "added", F.col("change") == "removed"
    return diff.agg(
        F.count_if(~added).alias("previously"),
        F.count_if(~removed).alias("now"),
        (F.count_if(added) - F.count_if(removed)).alias("net_change"),
        F.count_if(added).alias("added"),
        F.count_if(removed).alias("removed"),
        F.count_if(~added & ~removed).alias("common"),
    )


def change_list(diff: DataFrame, key: str, shown: Sequence[str]) -> DataFrame:
    """Added and removed rows with the columns of the side they exist on."""
    is_new = F.col("change") == "added"
    return diff.filter(F.col("change").isin("added", "removed")).select(
        "change",
        key,
        *[F.when(is_new, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in shown],
    )


def value_mismatch(stored: DataFrame, live: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose live value is there and differs, case and outer blanks aside: one row per key.

    ``stored`` has a unique key; of several live rows any one that differs is enough, and
    the first such value by text is shown.
    """
    seen = live.select(key, strip(F.lower(F.coalesce(column, F.lit("")))).alias("_live")).distinct()
    differs = (F.col("_live") != "") & (
        F.col("_live") != strip(F.lower(F.coalesce(F.col(column), F.lit(""))))
    )
    found = first_per_key(stored.join(seen, key).filter(differs), [key], ["_live"])
    return found.withColumnRenamed("_live", f"live_{column}")


def mismatch_report(
    mismatched: DataFrame, stored: DataFrame, key: str, shown: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Per mismatched id the columns of its first stored row, '' when there is none."""
    first = first_per_key(stored.select(key, *shown, *[o for o in order if o not in shown]), [key], order)
    ids = mismatched.select(key).distinct()
    return ids.join(first.select(key, *shown), key, "left").select(
        key, *[F.coalesce(c, F.lit("")).alias(c) for c in shown]
    )


def enrich(
    rows: DataFrame,
    details: DataFrame,
    key: str,
    fields: Sequence[str],
    people: str,
    row_id: Sequence[str],
    order: Sequence[str] = (),
) -> DataFrame:
    """Left join of details with '' for absent ones; the detail list of people wins if any.

    Of several details of a key the last by ``order`` counts.
    """
    right = details.select(key, *fields, F.col(people).alias("_people"), *[F.col(o).alias(f"_o_{o}") for o in order])
    right = _last(right, key, [f"_o_{o}" for o in order])
    joined = skew_join(rows, right, [key], row_id)
    return joined.withColumns(
        {
            **{f: F.coalesce(f, F.lit("")) for f in fields},
            people: F.when(~empty(F.col("_people")), F.col("_people")).otherwise(F.col(people)),
        }
    ).drop("_people")


def attach_list(
    rows: DataFrame, lists: DataFrame, key: str, column: str, row_id: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Left join of one list per key, the last by ``order``; rows without a list get an empty one."""
    right = lists.select(key, column, *[F.col(o).alias(f"_o_{o}") for o in order])
    joined = skew_join(rows, _last(right, key, [f"_o_{o}" for o in order]), [key], row_id)
    dtype = dict(lists.dtypes)[column]
    return joined.withColumn(column, F.coalesce(column, F.array().cast(dtype)))


def fill_missing(
    rows: DataFrame, found: DataFrame, key: str, column: str, row_id: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Fill ``column`` from ``found`` where missing; ``updated`` marks the filled rows.

    Of several finds of a key the last by ``order`` counts.
    """
    right = found.select(key, F.col(column).alias("_found"), *[F.col(o).alias(f"_o_{o}") for o in order])
    right = _last(right, key, [f"_o_{o}" for o in order])
    joined = skew_join(rows, right, [key], row_id)
    fill = missing(F.col(column)) & F.col("_found").isNotNull()
    return (
        joined.withColumn("updated", fill)
        .withColumn(column, F.when(F.col("updated"), F.col("_found")).otherwise(F.col(column)))
        .drop("_found")
    )


def patch_columns(
    rows: DataFrame, patch: DataFrame, key: str, columns: Sequence[str], mode: str = "fill", order: Sequence[str] = ()
) -> DataFrame:
    """Set a group of columns from a patch; of several patch rows of a key the last by ``order`` counts.

    ``fill`` keeps a present value when the patch has none for it; ``overwrite`` takes all
    the patch's columns for a matched row, so a present value can become ''.
    """
    if mode not in ("fill", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    right = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns], *[F.col(o).alias(f"_o_{o}") for o in order])
    right = _last(right, key, [f"_o_{o}" for o in order]).withColumn("_hit", F.lit(True))
    joined = rows.join(right, key, "left")
    out = {}
    for c in columns:
        new = F.coalesce(F.col(f"_p_{c}"), F.lit(""))
        use = F.col("_hit").isNotNull()
        if mode == "fill":
            use = use & (new != "")
        out[c] = F.when(use, new).otherwise(F.col(c))
    return joined.withColumns(out).select(*rows.columns)


def replace_rows(
    rows: DataFrame, fresh: DataFrame, key: str, keep: Sequence[str], fresh_id: str, order: Sequence[str] = ()
) -> DataFrame:
    """Take the fresh row where its own id agrees with the key, except for the ``keep`` columns.

    ``fresh`` has ``key`` (the id asked for) and ``fresh_id`` (the id found); of several rows
    of a key the last by ``order`` counts.
    """
    swap = [c for c in rows.columns if c != key and c not in keep]
    right = fresh.select(
        key, F.col(fresh_id).alias("_id"), *[F.col(c).alias(f"_f_{c}") for c in swap], *[F.col(o).alias(f"_o_{o}") for o in order]
    )
    joined = rows.join(_last(right, key, [f"_o_{o}" for o in order]), key, "left")
    ok = F.equal_null(F.col("_id"), F.col(key)) & F.col("_id").isNotNull()
    out = {c: F.when(ok, F.col(f"_f_{c}")).otherwise(F.col(c)) for c in swap}
    return joined.withColumns(out).select(*rows.columns)


def lookup(
    rows: DataFrame, table: DataFrame, key: str, value: str, default: str = "", order: Sequence[str] = ()
) -> DataFrame:
    """Left join of a label table, ``default`` where the label is unknown.

    Of several entries of a label the last by ``order`` counts. A frequent label is dealt
    over many tasks if the table is too large to be broadcast.
    """
    entries = table.select(key, value, *[F.col(o).alias(f"_o_{o}") for o in order])
    joined = skew_join(rows, _last(entries, key, [f"_o_{o}" for o in order]), [key], rows.columns)
    return joined.withColumn(value, F.coalesce(value, F.lit(default)))


def check_references(
    rows: DataFrame, row_key: str, titles: str, known: DataFrame, title: str
) -> DataFrame:
    """Split each row's titles into those that exist and those that dangle, in their order.

    ``row_key`` is unique. A row without titles comes out with two empty lists.
    """
    named = rows.select(row_key, F.posexplode_outer(titles).alias("_pos", title))
    exists = known.select(title).distinct().withColumn("_known", F.lit(True))
    marked = skew_join(named, exists, [title], [row_key, "_pos"])
    kept = F.collect_list(F.when(F.col("_known"), F.struct("_pos", title)))
    absent = F.col("_known").isNull() & F.col(title).isNotNull()
    lost = F.collect_list(F.when(absent, F.struct("_pos", title)))
    in_order = lambda c: F.transform(F.array_sort(c), lambda s: s[title])
    return marked.groupBy(row_key).agg(in_order(kept).alias("resolved"), in_order(lost).alias("dangling"))


def upsert(base: DataFrame, updates: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of ``updates`` overwrite ``base`` rows of the same key; the last update wins."""
    both = base.withColumn("_side", F.lit(0)).unionByName(
        updates.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    return last_per_key(both, [key], ["_side", *order]).drop("_side")


def override_column(
    rows: DataFrame, index: DataFrame, key: str, column: str, order: Sequence[str] = ()
) -> DataFrame:
    """The index's value of ``column`` wins over the extracted one when it has any.

    Of several index rows of a key the last by ``order`` counts.
    """
    right = index.select(key, F.col(column).alias("_index"), *[F.col(o).alias(f"_o_{o}") for o in order])
    right = _last(right, key, [f"_o_{o}" for o in order])
    joined = rows.join(right, key, "left")
    value = F.coalesce(F.nullif(F.col("_index"), F.lit("")), F.col(column))
    return joined.withColumn(column, value).drop("_index").select(*rows.columns)


def override_by_name(
    rows: DataFrame, known: DataFrame, name: str, rule: Column, out: str, order: Sequence[str] = ()
) -> DataFrame:
    """A table of special cases (name, value) goes before the rule.

    Names are compared in lower case; of several entries of a name the last by ``order``
    counts. A table of any size will do.
    """
    cases = known.select(F.lower("name").alias("_name"), F.col("value").alias("_known"), *[F.col(o).alias(f"_o_{o}") for o in order])
    cases = _last(cases, "_name", [f"_o_{o}" for o in order])
    joined = skew_join(rows.withColumn("_name", F.lower(name)), cases, ["_name"], rows.columns)
    return joined.withColumn(out, F.coalesce("_known", rule)).drop("_name", "_known")


def verify_and_replace(
    stored: DataFrame,
    live: DataFrame,
    pages: DataFrame,
    key: str,
    column: str,
    keep: Sequence[str],
    extract: Callable[[DataFrame], DataFrame],
    fresh_id: str = "found_id",
    order: Sequence[str] = (),
) -> DataFrame:
    """Compare stored with live values, extract the pages of those that differ anew, and replace them.

    Only pages of mismatched keys reach ``extract``, which returns rows with ``key``, ``fresh_id``
    and the columns of ``stored``; ``keep`` columns stay as stored, and a page whose own id is
    another leaves its row as it is.
    """
    wrong = value_mismatch(stored, live, key, column).select(key)
    fresh = extract(skew_join(pages, wrong, [key], pages.columns, "left_semi"))
    return replace_rows(stored, fresh, key, keep, fresh_id, order)
