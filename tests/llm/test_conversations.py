"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib

from pyspark.sql import functions as F

from recordloom.llm.conversation_repair import Walk, damaged, op13_conversation_repair, repair_digests, repair_edits
from tests.llm.tables import CLASH

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    """blank, duplicate, truncated or nothing for each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACES)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows):
    """Cheapest edits, least letters first: uniform cost over every way, no way is dropped."""
    found, heap, n = faults(rows), [(0, "", 0, "", ())], len(rows)
    while True:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        if i == n and (roles == "" or roles.endswith("a")):
            return cost, audit, lines
        full = {"u": "user", "a": "assistant"}
        heapq.heappush(heap, (cost + 2, audit + "I", i, roles + after, (*lines, full[after] + ":")))
        if i < n:
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, lines))
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                if role[:1] == after or (role[:1] == "s" and not roles):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + after, (*lines, f"{full[after]}:{text}")))


def brute(rows):
    """What op13 returns for (conv_id, turn, role, text) rows that are damaged already."""
    out = []
    for conv_id in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv_id]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        marks = faults(own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = search(own)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv_id, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def draw_rows(seed, conversations, most=6):
    draw, rows = random.Random(seed), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "ua"]
    texts = ["Yes.", "No!", "cut", "Why? \n", "", " \t", None, "end.\x0b", "é…", "a\x85", "Yes."]
    for conv_id in [*range(conversations), None]:
        for turn in range(draw.randint(1, most)):
            rows.append((conv_id, draw.choice([turn, turn, turn + 1, None]), draw.choice(roles), draw.choice(texts)))
    return rows


def got(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_digests_equal_a_search(spark):
    rows = draw_rows(1, 150)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in [*CLASH, "there", "fault", "first", "one", "two", "copy"]})
    assert got(repair_digests(df)) == brute(rows)


def test_hot_repeats_beyond_broadcasts(spark, monkeypatch):
    few = [r for r in draw_rows(2, 60) if r[0] != 7]
    rows = few + [(7, 1, "user", "Yes.")] * 400
    monkeypatch.setattr("recordloom.llm.conversation_repair.small", lambda df: df)
    have = {r[0]: r for r in got(repair_digests(spark.createDataFrame(rows, SCHEMA)))}
    assert have.pop(7)[1:8] == (0, 0, 399, 0, 399, 2 + 3 * 399, "K" + "D" * 399 + "I")
    assert have == {r[0]: r for r in brute(few)}


def test_damage_and_query(spark, tmp_path):
    rows = draw_rows(3, 120, most=7) + [(500, 1, "user", "Alone."), (-3, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    after = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        after += [(conv_id, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    gone = {r[0] for r in rows} - {r[0] for r in after}
    empty = [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone]
    assert got(op13_conversation_repair(spark, str(tmp_path))) == sorted(brute(after) + empty, key=str)
    assert got(repair_digests(damaged(spark.createDataFrame([], SCHEMA)), there=F.col("there"))) == []


def test_edits_are_the_repaired_rows(spark):
    rows = draw_rows(4, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    edits = repair_edits(df).orderBy("conv_id", "row", "step").collect()
    for conv_id, *_, audit, digest in got(repair_digests(df)):
        own = [r for r in edits if r["conv_id"] == conv_id]
        assert "".join(r["edit"][0] for r in own) == audit
        text = "\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "Delete")
        assert hashlib.sha256(text.encode()).hexdigest() == digest


def test_survivors_agree_early():
    """A long conversation is written out on the way: what is not agreed on stays short."""
    written, most = [], 0
    walk = Walk(lambda letter, role, row: written.append(letter), lambda n: written.append("D" * n))
    draw = random.Random(5)
    for i in range(20_000):
        if draw.random() < 0.05:
            walk.must_go()
        else:
            walk.row("ua"[i % 2] if draw.random() < 0.9 else "s", draw.randint(0, 1), i)
        most = max(most, len(walk._way(next(iter(walk.survivors.values()))[2])))
    assert most < 200
    for _ in range(100_000):
        walk.must_go()
    assert len(walk._way(next(iter(walk.survivors.values()))[2])) < 200
    walk.end()
    assert sum(x != "I" for x in "".join(written)) == 120_000
