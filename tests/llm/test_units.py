"""Repeated units are cut out of the rows they are in."""

import random

import pytest

from recordloom.llm.unit_dedup import passages_of, repeated_units, without_repeats, without_spans
from tests.llm.tables import docs, words


def test_a_repeated_passage_of_short_lines_goes(spark):
    passage = "\n".join(words(60 + k, 3 + k % 4) for k in range(14))
    df = docs(spark, [(1, f"a\n{passage}\nb", None, None, None), (2, f"c\n{passage}\n\nd", None, None, None), (3, "a\nb", None, None, None)])
    assert repeated_units(df).count() == 0
    got = {r["doc_id"]: r["text"] for r in without_repeats(df).collect()}
    assert got == {1: f"a\n{passage}\nb", 2: "c\n\nd", 3: "a\nb"}


def test_passages_of_every_layout_are_covered(spark):
    draw = random.Random(8)
    for k in range(50):
        passage = "\n".join(words(1000 * k + i, draw.randint(1, 9)) for i in range(30))
        df_rows = [(1, f"{words(k, 3)}\n{passage}\n{words(k + 1, 2)}"), (2, f"{words(k + 2, 4)}\n{passage}\n{words(k + 3, 5)}")]
        places = [{u[3]: u for u in passages_of(t)} for _, t in df_rows]
        left = df_rows[1][1]
        cut = sorted(u[:2] for d, u in places[1].items() if d in places[0])
        covered = {c for a, b in cut for c in range(a, b + 1)}
        rest = "".join(c for i, c in enumerate(left) if i not in covered)
        assert rest == f"{words(k + 2, 4)}\n{words(k + 3, 5)}"


def test_rows_are_cut_by_themselves(spark):
    unit, other = words(70, 25), words(71, 25)
    rows = [(5, unit), (5, unit), (5, f"{other}\nx"), (None, f"y\n{unit}"), (None, f"{other}\nz"), (6, other)]
    df = docs(spark, [(i, t, None, None, None) for i, t in rows])
    got = [r["text"] for r in without_repeats(df).collect()]
    assert sum(t.count(unit) for t in got) == 1 and sum(t.count(other) for t in got) == 1
    assert sorted(t.replace(unit, "").replace(other, "").strip() for t in got) == ["", "", "", "x", "y", "z"]
    with pytest.raises(ValueError):
        without_spans(df, repeated_units(df))
    alone = docs(spark, [(1, unit, None, None, None), (None, f"{unit}\nz", None, None, None)])
    assert {r["text"] for r in without_spans(alone, repeated_units(alone)).collect()} == {unit, "z"}


def test_columns_of_any_name_stay(spark):
    names = ["_id", "_doc", "_spans", "_row", "id", "doc", "spans", "start", "end"]
    rows = [(i, t, None, None, None) for i, t in [(1, words(7, 25)), (2, words(7, 25) + "\nx")]]
    df = docs(spark, rows).drop(*names).selectExpr("*", *[f"'{c}' as `{c}`" for c in names])
    for got in (without_repeats(df), without_spans(df, repeated_units(df))):
        assert got.columns == df.columns
        assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: words(7, 25), 2: "x"}
        assert all(r[c] == c for r in got.collect() for c in names)
