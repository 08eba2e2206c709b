"""Repeated stretches of words, wherever they lie."""

import pytest

from recordloom.llm import ORACLES, QUERIES
from recordloom.llm.stretch_dedup import repeated_stretches
from tests.conftest import FOLDER
from tests.llm.tables import cases, docs, words
from tests.oracle import compare


def brute(rows, width):
    """(id, start, end, words) of runs of windows that an earlier place has, by strings."""
    places, order = {}, sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    spans = {}
    for n in order:
        at, spans[n], text = 0, [], rows[n][1] or ""
        for w in text.encode().split():
            at = text.index(w.decode(), at)
            spans[n].append((at, at + len(w.decode())))
            at += len(w.decode())
        said = [text[a:b].encode().lower() for a, b in spans[n]]
        for i in range(len(said) - width + 1):
            places.setdefault(tuple(said[i : i + width]), []).append((rows[n][0] is None, rows[n][0] or 0, spans[n][i][0], n, i))
    gone = {(p[3], p[4]) for same in places.values() for p in same if p != min(same)}
    out = []
    for n, i in sorted(gone):
        if (n, i - 1) not in gone:
            j = i
            while (n, j + 1) in gone:
                j += 1
            out.append((rows[n][0], spans[n][i][0], spans[n][j + width - 1][1], j + width - i))
    return sorted(map(str, out))


def found(spark, rows, **more):
    got = repeated_stretches(docs(spark, [(*r[:2], None, None, None) for r in rows]), **more).select("doc_id", "start", "end", "words")
    return sorted(str(tuple(r)) for r in got.collect())


def test_passages_inside_lines_are_found(spark):
    rows = []
    for k in range(12):
        passage = words(700 + k, 60)
        rows += [(2 * k, f"{words(k, 9)} {passage} {words(k + 50, 7)}"), (2 * k + 1, f"{words(k + 90, 5)}\t{passage.upper().replace('É', 'é').replace('SS', 'ß')}\n{words(k + 30, 70)}")]
    got = found(spark, rows)
    assert len(got) == 12 and got == brute(rows, 50)


@pytest.mark.parametrize("width", [3, 50])
def test_stretches_are_those_of_brute_force(spark, width):
    rows = [r[:2] for r in cases()] + [(20, "a b " * 90), (20, "a b " * 90), (21, f"x {'B a ' * 40}\n{words(4, 40)} {words(3, 30)}"), (22, words(1, 20_000)[5000:9000])]
    got = found(spark, rows, min_words=width)
    assert got == brute(rows, width) and got
    assert found(spark, []) == []


def test_query_equals_sql(spark, con):
    name = "op3_stretch_dedup"
    got, want = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name])
    assert got == want and want[1]
