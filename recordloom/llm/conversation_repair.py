"""Conversation structure repair by a Viterbi walk whose survivors coalesce.

A repaired conversation has the roles ``(system? (user assistant)+)?``. The walk reads the rows of
a conversation in order and keeps, for each of the four states of that grammar, the cheapest way
to reach it: a leaf of a tree of edits, whose nodes count their children. A leaf that no new
leaf grows from is taken off with all that only it needed. As soon as the root has a single child,
every survivor agrees on that edit: it is written out and forgotten. So a task holds the rows
since the survivors last agreed, however long the conversation is.

Of equally cheap ways the one whose letters come first stays. Survivors are kept in the order
of their whole letters: none is the beginning of another, as all of them have read the same rows
and end with the letter of the last one. So the order of two tied ways is that of the survivors
they grow from or, within one, that of their last letters: the whole unresolved letters are
compared, without walking them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from recordloom.llm.registry import query
from recordloom.llm.shared import join_counted, keep, read, short_batches, small

SPACES = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"

#: What follows in each state: the role that may come next (but for a system row at the start), and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: What a conversation that ends in a state lacks.
LACKS = {START: (), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
#: First letters of roles that may be neighbours.
LEGAL = ("su", "ua", "au")
#: Rows that leave a task at once.
BATCH = 1_000


#: LEAD[x][y]: whatever can follow in state y can follow in x for so much more at most. A survivor that
#: is more than that behind another one can't be part of the cheapest way, and is dropped.
LEAD = {
    START: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {START: 2 * INSERT, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT},
}


class Node:
    """One step of a way: roles put in before a row, what becomes of the row, and how many rows after it must go."""

    __slots__ = ("parent", "children", "inserts", "letter", "role", "row", "gone")

    def __init__(self, parent, inserts=(), letter="", role=None, row=None):
        self.parent, self.children, self.gone = parent, 0, 0
        self.inserts, self.letter, self.role, self.row = inserts, letter, role, row


def _ways() -> dict[tuple[int, str], list[tuple]]:
    """(state, initial) to all that can be done with a row: (cost, letters, inserts, role or None to keep it, next state).

    Roles are put in before rows that stay only: before a row that goes, the same edits in the
    other order cost the same and come first.
    """
    ways = {}
    for state in NEXT:
        for initial in ("s", "u", "a", ""):
            found = [(DELETE, "D", (), None, state)]
            if state == START and initial == "s":
                found.append((0, "K", (), None, SYSTEM))
            at, inserts, cost = state, (), 0
            for _ in range(2):
                role, then = NEXT[at]
                if initial == role[0]:
                    found.append((cost, "I" * len(inserts) + "K", inserts, None, then))
                found.append((cost + REROLE, "I" * len(inserts) + "R", inserts, role, then))
                at, inserts, cost = then, (*inserts, role), cost + INSERT
            ways[state, initial] = found
    return ways


WAYS = _ways()


class Walk:
    """The walk over one conversation. ``emit(letter, role, row)`` gets every edit once all survivors agree on it.

    A run of rows that must go is a number in the leaves: ``gone(n)`` gets it in its place.
    """

    def __init__(self, emit: Callable, gone: Callable):
        self.emit, self.gone = emit, gone
        self.root = Node(None)
        self.survivors = {START: (0, 0, self.root)}  # state: cost, place in the order of letters, leaf

    def must_go(self) -> None:
        """One more row, which can only be deleted."""
        for state, (cost, order, leaf) in self.survivors.items():
            leaf.gone += 1
            self.survivors[state] = (cost + DELETE, order, leaf)
        if len(self.survivors) == 1:
            self.gone(self.root.gone)
            self.root.gone = 0

    def row(self, initial: str, extra: int, row) -> None:
        """One more row. ``extra`` is what it costs unless it goes; ``row`` is handed on."""
        initial = initial if initial in ("s", "u", "a") else ""
        best: dict[int, tuple] = {}
        for state, (cost, order, leaf) in self.survivors.items():
            for more, letters, inserts, role, then in WAYS[state, initial]:
                key = (cost + more + (0 if letters == "D" else extra), order, letters)
                if then not in best or key < best[then][0]:
                    best[then] = (key, leaf, inserts, role)
        old = [leaf for _, _, leaf in self.survivors.values()]
        self.survivors = {}
        behind = [y for y in best if any(best[y][0][0] > best[x][0][0] + LEAD[x][y] for x in best if x != y)]
        ordered = sorted((x for x in best.items() if x[0] not in behind), key=lambda x: x[1][0][1:])
        for place, (state, ((cost, _, letters), leaf, inserts, role)) in enumerate(ordered):
            leaf.children += 1
            self.survivors[state] = (cost, place, Node(leaf, inserts, letters[-1], role, row))
        for leaf in old:
            while leaf is not None and leaf.children == 0:
                leaf, out = leaf.parent, leaf
                out.parent = None
                if leaf is not None:
                    leaf.children -= 1
        if self.root.children == 1:
            self._agree()

    def _agree(self) -> None:
        """Write out what all survivors share: the way down to the first node with several children, or none."""
        for node in self._way(next(iter(self.survivors.values()))[2]):
            if self.root.children != 1:
                break
            self._write(node)
            self.root, node.parent = node, None

    def _way(self, leaf: Node) -> list[Node]:
        way = []
        while leaf is not self.root:
            way.append(leaf)
            leaf = leaf.parent
        return way[::-1]

    def _write(self, node: Node) -> None:
        """Write out a child of the root, after the rows that must go before it."""
        if self.root.gone:
            self.gone(self.root.gone)
        for role in node.inserts:
            self.emit("I", role, None)
        self.emit(node.letter, node.role, node.row)

    def end(self) -> int:
        """Write out the rest of the best way; what all edits cost."""
        ends = [((cost + INSERT * len(LACKS[s]), order), s, leaf) for s, (cost, order, leaf) in self.survivors.items()]
        (cost, _), state, leaf = min(ends, key=lambda x: x[0])
        for node in self._way(leaf):
            self._write(node)
            self.root = node
        if self.root.gone:
            self.gone(self.root.gone)
        for role in LACKS[state]:
            self.emit("I", role, None)
        return cost


def ordered_rows(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None
) -> DataFrame:
    """conv_id, turn, role, text, there, fault (blank, duplicate, truncated or null), in order within partitions.

    Rows for which ``there`` does not hold only name their conversation. Rows come by turn, nulls
    first, then by role and text; null roles and texts count as one space, and all rows without
    conv_id are one conversation. Of rows with the same role and text in a conversation all but
    the first are duplicates. Rows that repeat throughout are all there.

    First occurrences are an aggregate over digests (two 64-bit hashes), and only those of repeated
    rows go back to the rows: broadcast if they are few, else by a join that deals out hot ones. The
    text is shuffled once, by conversation.
    """
    there = F.lit(True) if there is None else there
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), there.alias("there"),
    )
    of = ["conv_id", F.col("conv_id").isNull(), "role", "text"]
    rows = rows.withColumns({"one": F.xxhash64(F.lit(1), *of), "two": F.xxhash64(F.lit(2), *of)})
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = rows.filter("there").groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = keep(first, "repair-repeated")
    few = small(first)
    if few is first:
        marked = join_counted(rows, first, ["one", "two"], "n", ["turn"], how="left")
    else:
        marked = rows.join(few, ["one", "two"], "left")
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", BLANK).when(F.col("first") < place, DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED)
    marked = marked.select("conv_id", "turn", "role", "text", "there", fault.alias("fault"))
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _events(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, row) of each row, (conv_id, None) before a conversation's rows, and a last (None, None)."""
    at, before, begun = None, None, False
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "there", "fault"))
        for conv_id, turn, role, text, there, fault in zip(*columns):
            if not begun or conv_id != at:
                at, before, begun = conv_id, None, True
                yield at, None
            if there:
                # in this order rows of one turn, role and text are neighbours
                if fault != BLANK and before == (turn, role, text):
                    fault = DUPLICATE
                before = (turn, role, text)
                yield at, (turn, role, text, fault)
    if begun:
        yield None, None


def _walk_row(walk: Walk, role: str, fault: str | None, row) -> None:
    if fault in (BLANK, DUPLICATE):
        walk.must_go()
    else:
        walk.row(role[:1], LEFT_TRUNCATED if fault == TRUNCATED else 0, row)


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    rows.clear()
    return batch


def repair_edits(conversations: DataFrame, **names) -> DataFrame:
    """The edits of every conversation: conv_id, row, step, edit, turn, role, text.

    ``edit`` is Keep, Rerole, Delete or Insert; role and text are what stands there after the repair
    (for Delete, what stood there before). ``row`` counts a conversation's rows from 1. What is put in
    comes before its row as step 0, the row is step 1; what is put in at the end has a row of its
    own. So (row, step) is the order, and the repaired conversation is all but Delete. Names and
    order of rows as for ``ordered_rows``.
    """
    rows = ordered_rows(conversations, **names)
    ids = StructType([StructField(n, rows.schema[n].dataType) for n in ("conv_id", "turn")])
    schema = StructType([
        ids["conv_id"], StructField("row", LongType()), StructField("step", LongType()), StructField("edit", StringType()), ids["turn"],
        StructField("role", StringType()), StructField("text", StringType()),
    ])
    arrow = to_arrow_schema(schema)
    words = {"K": "Keep", "R": "Rerole", "D": "Delete", "I": "Insert"}

    def edits(batches):
        out, walk = [], None

        def fresh(conv_id):
            waiting = []  # what is put in before the next row

            def emit(letter, role, row):
                if letter == "I":
                    waiting.append(role)
                    return
                n, turn, old, text = row
                put_in(conv_id, n, waiting)
                out.append((conv_id, n, 1, words[letter], turn, role or old, text))

            return Walk(emit, lambda n: None), waiting

        def put_in(conv_id, n, waiting):
            out.extend((conv_id, n, step, "Insert", None, role, "") for step, role in enumerate(waiting))
            waiting.clear()

        def finish(conv_id, n):
            walk.end()
            put_in(conv_id, n + 1, waiting)

        n, at, waiting = 0, None, []
        for conv_id, row in _events(batches):
            if row is None:
                if walk is not None:
                    finish(at, n)
                (walk, waiting), at, n = fresh(conv_id), conv_id, 0
            else:
                n += 1
                if row[3] in (BLANK, DUPLICATE):  # certain at once
                    out.append((conv_id, n, 1, "Delete", *row[:3]))
                _walk_row(walk, row[1], row[3], (n, *row[:3]))
            if len(out) >= BATCH:
                yield _packed(out, arrow)
        if out:
            yield _packed(out, arrow)

    return short_batches(rows).mapInArrow(edits, schema)


class Digest:
    """What one conversation sums up to, fed row by row and edit by edit."""

    def __init__(self):
        self.turns, self.last = 0, None  # distinct turns; the turn before
        self.least = self.most = None
        self.faults = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.illegal, self.initial = 0, None
        self.audit, self.hash, self.empty = [], hashlib.sha256(), True
        self.walk = Walk(self.edit, lambda n: self.audit.append("D" * n))

    def row(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last, self.most = self.turns + 1, turn, turn
            self.least = turn if self.least is None else self.least
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        _walk_row(self.walk, role, fault, (role, text))

    def edit(self, letter: str, role: str | None, row) -> None:
        self.audit.append(letter)
        if letter != "D":
            old, text = row or (None, "")
            self.hash.update(f"{'' if self.empty else chr(10)}{role or old}:{text}".encode())
            self.empty = False

    def end(self) -> tuple:
        cost = self.walk.end()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


def repair_digests(conversations: DataFrame, **names) -> DataFrame:
    """A row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``gaps`` counts turns that are missing between the first and the last, ``illegal`` neighbours whose
    roles' first letters are not su, ua or au; ``audit`` is the first letters of the edits, and the
    digest is of the repaired rows as role:text, a line each. A conversation of which no row is
    ``there`` has zeros, no audit and the digest of an empty text. Turns are whole numbers here.

    The digest is fed as edits are agreed on: of a conversation a task holds the letters of its
    edits and the rows the survivors do not agree on yet.
    """
    rows = ordered_rows(conversations, **names)
    counts = [StructField(n, LongType()) for n in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")]
    texts = [StructField(n, StringType()) for n in ("audit", "repaired_sha256")]
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *counts, *texts])
    arrow = to_arrow_schema(schema)

    def digests(batches):
        out, digest, at = [], None, None
        for conv_id, row in _events(batches):
            if row is None:
                if digest is not None:
                    out.append((at, *digest.end()))
                digest, at = Digest(), conv_id
                if len(out) >= BATCH:
                    yield _packed(out, arrow)
            else:
                digest.row(*row)
        if out:
            yield _packed(out, arrow)

    return short_batches(rows).mapInArrow(digests, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults that a checksum of conv_id and turn decides; rows to drop have ``there`` false."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fate"),
    )
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    there = (F.col("fate") != 0).alias("there")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), there, F.explode(times).alias("copy")).drop("copy")


@query(
    "op13_conversation_repair",
    """
    with recursive base as (
      select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
      from conversations),
    fates as (
      select *, xor(4294967295, list_reduce(
        list_transform(range(1, len(key) + 1), lambda i: ascii(key[i])::bigint),
        lambda c, b: list_reduce(range(8), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end, xor(c, b)),
        4294967295)) % 20 as fate
      from base),
    rows_after as (
      select conv_id, turn, case when fate = 4 then 'user' else role end as role,
        case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case fate when 0 then [] when 3 then [0, 1] else [0] end) as copy
      from fates),
    numbered as (
      select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
        left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text, copy) as earlier,
        case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
          when row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 then 'duplicate'
          when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault
      from rows_after),
    steps (st, letters, need, put, then_st, cost) as (values
      ('E', 'D', '', [], 'E', 3), ('S', 'D', '', [], 'S', 3), ('U', 'D', '', [], 'U', 3), ('A', 'D', '', [], 'A', 3),
      ('E', 'K', 's', [], 'S', 0), ('E', 'K', 'u', [], 'U', 0), ('S', 'K', 'u', [], 'U', 0), ('A', 'K', 'u', [], 'U', 0), ('U', 'K', 'a', [], 'A', 0),
      ('E', 'IK', 'a', ['user'], 'A', 2), ('S', 'IK', 'a', ['user'], 'A', 2), ('A', 'IK', 'a', ['user'], 'A', 2), ('U', 'IK', 'u', ['assistant'], 'U', 2),
      ('E', 'R', '', ['user'], 'U', 2), ('S', 'R', '', ['user'], 'U', 2), ('A', 'R', '', ['user'], 'U', 2), ('U', 'R', '', ['assistant'], 'A', 2),
      ('E', 'IR', '', ['user', 'assistant'], 'A', 4), ('S', 'IR', '', ['user', 'assistant'], 'A', 4), ('A', 'IR', '', ['user', 'assistant'], 'A', 4),
      ('U', 'IR', '', ['assistant', 'user'], 'U', 4)),
    walk as (
      select distinct conv_id, 0::bigint as i, 'E' as st, 0::bigint as cost, '' as audit, []::varchar[] as lines from conversations
      union all
      select conv_id, i, st, cost, audit, lines from (
        select n.conv_id, n.i, s.then_st as st,
          w.cost + s.cost + case when n.fault = 'truncated' and s.letters <> 'D' then 1 else 0 end as cost,
          w.audit || s.letters as audit,
          w.lines || case s.letters when 'D' then [] when 'K' then [n.role || ':' || n.text]
            when 'IK' then [s.put[1] || ':', n.role || ':' || n.text] when 'R' then [s.put[1] || ':' || n.text]
            else [s.put[1] || ':', s.put[2] || ':' || n.text] end as lines
        from walk w join numbered n on n.conv_id is not distinct from w.conv_id and n.i = w.i + 1
          join steps s on s.st = w.st and (s.need = '' or s.need = n.initial)
            and (n.fault not in ('blank', 'duplicate') or s.letters = 'D'))
      qualify row_number() over (partition by conv_id, st order by cost, audit) = 1),
    ends (st, letters, put, cost) as (values
      ('E', '', []::varchar[], 0), ('A', '', [], 0), ('U', 'I', ['assistant:'], 2), ('S', 'II', ['user:', 'assistant:'], 4)),
    best as (
      select conv_id, w.cost + e.cost as cost, w.audit || e.letters as audit, sha256(array_to_string(w.lines || e.put, chr(10))) as repaired_sha256
      from walk w join ends e using (st)
      where i = (select count(*) from rows_after r where r.conv_id is not distinct from w.conv_id)
      qualify row_number() over (partition by conv_id order by w.cost + e.cost, w.audit || e.letters) = 1),
    counts as (
      select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (earlier is not null and earlier || initial not in ('su', 'ua', 'au')) as illegal
      from numbered group by conv_id)
    select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
      coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cost, audit, repaired_sha256
    from best b left join counts c on c.conv_id is not distinct from b.conv_id
    """,
)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_digests(damaged(read(spark, folder, "conversations")), there=F.col("there"))
