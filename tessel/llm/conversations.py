"""Repair of conversations by cheapest edits (operator 13).

A conversation in order has the role initials ``(s?(ua)+)?``. Its rows, in the order of their turns,
are kept, given another role, deleted, or empty ones are inserted, at small integer costs. An edit
goes from a node (rows read, state of the pattern) to another; distances to the end are recorded
by Dial's bucket queue, which holds a bucket for each distance, and the cheapest edits are then
walked from the start, taking of the arcs that are tight (cost = difference of the distances) the one whose
initial comes first. From a node no two arcs have the same initial, so that walk gives the
ASCII-least of the cheapest audits.

A conversation's rows meet in one task, sorted by Spark, which spills: its audit is one string and the
digest of its repaired text is sequential, so rows of one conversation can't be shared out. The task
reads them as a stream. It holds one byte a row, as the audit does, and distances of ``STRETCH`` rows
at a time, with the distances at each stretch's end; texts beyond ``HELD`` bytes wait in a temporary file
of the task. Duplicates are found by Spark beforehand (a window over equal rows, by digests).

Faults, the first that holds: blank (nothing but white space), duplicate (role and text were seen
earlier in the conversation), truncated (doesn't end in one of ``.!?``). Null roles and texts count as one space.
Null turns come first; rows of one turn are ordered by role, then by the digest of role and text. Null conversation
ids are one conversation. Texts are read whole, however long. Repeated rows are duplicates.
Extra columns, also with clashing names, aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, place

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Costs of the edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Rows whose distances are held at once; bytes of text that are held in memory.
STRETCH, HELD = 4096, 32 << 20
#: Rows of a batch that goes back to Spark, and bytes of text in it, about.
BATCH, BATCH_BYTES = 2000, 4 << 20

# States: nothing yet, after the system's row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 62
#: What follows a state by a role's initial.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that an inserted or changed row gets in each state.
NEXT = ["u", "u", "a", "u"]
ROLE = {"u": "user", "a": "assistant"}
#: A row's byte: its initial's place here, plus 4 if it has to go, plus 8 if it is truncated.
INITIALS, GONE, TRUNCATED = "sua", 4, 8


def arcs(code: int) -> list[tuple[int, int, int]]:
    """(state, next state, cost) of the cheapest arc between two states that reads a row."""
    out = {(q, q): DELETE for q in range(4)}
    if not code & GONE:
        more = CUT if code & TRUNCATED else 0
        for q in range(4):
            to = STEPS[NEXT[q]][q]
            out[q, to] = REROLE + more
        for q, to in STEPS.get(INITIALS[code & 3 : (code & 3) + 1], {}).items():
            out[q, to] = more
    return [(q, to, cost) for (q, to), cost in out.items()]


#: By a row's byte and the state that an arc leads to: (state it comes from, cost).
BACK = [[[(q, cost) for q, to, cost in arcs(code) if to == at] for at in range(4)] for code in range(16)]
#: The same for inserted rows.
BACK_INSERT = [[q for q in range(4) if STEPS[NEXT[q]][q] == at] for at in range(4)]


def distances(codes: bytes, end: list[int]) -> list[list[int]]:
    """Of each place between the rows and each state: the least cost to the end, whose distances
    are given."""
    n = len(codes)
    found = [[FAR] * 4 for _ in range(n + 1)]
    known = [d for d in end if d < FAR]
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(max(known) - min(known) + 1)]
    base = min(known)
    for q, d in enumerate(end):
        if d < FAR:
            found[n][q] = d
            buckets[d - base].append((n, q))
    at = 0
    while at < len(buckets):
        for i, q in buckets[at]:  # may grow meanwhile, by arcs without cost
            if found[i][q] != base + at:
                continue  # a shorter way was found since
            ways = [(i, p, INSERT) for p in BACK_INSERT[q]]
            if i:
                ways += [(i - 1, p, cost) for p, cost in BACK[codes[i - 1]][q]]
            for j, p, cost in ways:
                d = base + at + cost
                if d < found[j][p]:
                    found[j][p] = d
                    while len(buckets) <= at + cost:
                        buckets.append([])
                    buckets[at + cost].append((j, p))
        buckets[at] = []
        at += 1
    return found


def walk(codes: bytes, found: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The edits of these rows that are cheapest and come first, and the state they lead to.
    Rows inserted behind them are left to the next stretch, but for the last."""
    out, i = [], 0
    while i < len(codes) or last and found[i][state]:
        here, to = found[i][state], STEPS[NEXT[state]][state]
        code = codes[i] if i < len(codes) else GONE
        more = CUT if code & TRUNCATED else 0
        kept = None if code & GONE else STEPS.get(INITIALS[code & 3 : (code & 3) + 1], {}).get(state)
        if i < len(codes) and here == DELETE + found[i + 1][state]:
            out.append("D")
            i += 1
        elif here == INSERT + found[i][to]:
            out.append("I")
            state = to
        elif kept is not None and here == more + found[i + 1][kept]:
            out.append("K")
            i, state = i + 1, kept
        else:
            out.append("R")
            i, state = i + 1, to
    return "".join(out), state


def cheapest(codes: bytes, stretch: int = STRETCH) -> tuple[int, str]:
    """Cost and audit of a conversation whose rows these bytes describe."""
    starts = range(0, len(codes), stretch) or [0]
    ends = [[0, FAR, FAR, 0]]  # nothing at all, or an assistant's row at the end
    kept = None
    for at in reversed(starts):
        kept = distances(codes[at : at + stretch], ends[-1])
        ends.append(kept[0])
    ends.reverse()
    audit, state = [], START
    for k, at in enumerate(starts):
        part = codes[at : at + stretch]
        found = kept if len(starts) == 1 else distances(part, ends[k + 1])
        done, state = walk(part, found, state, k == len(starts) - 1)
        audit.append(done)
    return ends[0][START], "".join(audit)


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive) of ``df``, by the crc32 of ``conv_id:turn`` modulo 20: 0 loses
    a row (alive is false), 1 its text, 2 the marks ``.!?``, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    rows = numbered(df)
    conv, turn, role, text = (F.col(place(df, c)) for c in ("conv_id", "turn", "role", "text"))
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    act = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    text = F.when(act == 1, "").when(act == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    role = F.when(act == 4, "user").otherwise(space(role))
    copies = F.when(act == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (act != 0).alias("alive"), F.explode(copies).alias("copy")).drop("copy")


def faulted(df: DataFrame) -> DataFrame:
    """Rows in the order of their conversations: conv_id, turn, initial, role, text, alive, fault
    (null, blank, duplicate or truncated)."""
    rows = numbered(df)
    names = ["conv_id", "turn", "role", "text"]
    alive = F.col(place(df, "alive")) if "alive" in df.columns else F.lit(True)
    rows = rows.select(*(F.col(place(df, c)).alias(c) for c in names), alive.alias("alive"))
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    mark = F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256)
    rows = rows.withColumns({"mark": mark, "end": F.right(end, F.lit(1))}).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "alive", "mark").orderBy(F.col("turn").asc_nulls_first()))
    fault: Column = F.when(F.col("end") == "", "blank").when(seen > 1, "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    rows = rows.select("conv_id", "turn", "role", "text", "alive", "mark", fault.alias("fault"))
    # the first of equal rows comes before its repeats, as no other row can lie between those of one turn
    order = [F.col("turn").asc_nulls_first(), "role", "mark", F.col("fault").eqNullSafe("duplicate")]
    return rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order).drop("mark")


class Texts:
    """Texts in order, in memory and, beyond HELD bytes, in a file."""

    def __init__(self):
        self.file, self.sizes = tempfile.SpooledTemporaryFile(max_size=HELD), []

    def add(self, text: bytes) -> None:
        self.file.write(text)
        self.sizes.append(len(text))

    def __iter__(self) -> Iterator[bytes]:
        self.file.seek(0)
        for n in self.sizes:
            yield self.file.read(n)


class Conversation:
    def __init__(self, key):
        self.key, self.codes, self.kept = key, bytearray(), Texts()
        self.first = self.last = self.before = None
        self.distinct = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.turns: list = []

    def add(self, turn, role: str, text: bytes, fault: str | None) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault:
            self.faults[fault] += 1
        place = INITIALS.find(initial) if initial else -1
        self.codes.append((place if place >= 0 else 3) | (GONE if fault in ("blank", "duplicate") else TRUNCATED if fault else 0))
        self.kept.add(role.encode())
        self.kept.add(text)

    def rows(self) -> Iterator[tuple]:
        """(step, edit, role, text as bytes, facts): the facts first, then each edit."""
        cost, audit = cheapest(bytes(self.codes))
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        yield 0, None, None, None, (gaps, *self.faults.values(), self.illegal, cost)
        texts, state = iter(self.kept), START
        for step, edit in enumerate(audit, 1):
            role, text = ("", b"") if edit == "I" else (next(texts).decode(), next(texts))
            if edit in "IR":
                role = ROLE[NEXT[state]]
            if edit == "D":
                yield step, edit, None, None, None
            else:
                state = STEPS[role[:1]][state]
                yield step, edit, role, text, None


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size) -> Iterator[pa.RecordBatch]:
    """Record batches of ``BATCH`` rows or ``BATCH_BYTES`` at most, about."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += size(row)
        if len(out) >= BATCH or held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    now = None
    for b in batches:
        for key, turn, role, text, alive, fault in zip(*(b.column(i).to_pylist() for i in range(3)), (t.as_py() for t in b.column(3)), *(b.column(i).to_pylist() for i in (4, 5))):
            if now is None or key != now.key:
                if now:
                    yield now
                now = Conversation(key)
            if alive:
                now.add(turn, role, text.encode(), fault)
    if now:
        yield now


def repair(df: DataFrame) -> DataFrame:
    """The edits of each conversation of ``df`` (conv_id, turn, role, text and, if there is one, alive: rows
    that are not only name their conversation), in order: conv_id, step, edit (K, R, D or I), role and text of the
    repaired row (null where it is deleted). Step 0 of each conversation, without an edit, has its facts: gaps, blank, duplicate,
    truncated, illegal, cost."""
    rows = faulted(df)
    key, kind = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("turn must be an integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * len(FACTS)]

        def again():
            yield first
            yield from batches

        every = ((c.key, step, edit, role, text if text is None else text.decode(), *(facts or [None] * len(FACTS))) for c in read(again()) for step, edit, role, text, facts in c.rows())
        yield from batched(every, ["conv_id", "step", "edit", "role", "text", *FACTS], kinds, lambda r: len(r[4] or ""))

    return rows.mapInArrow(run, f"conv_id {key}, step bigint, edit string, role string, text string, {', '.join(f'{f} bigint' for f in FACTS)}")


def report(edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``'s edits, which still lie in order: conv_id, its facts, audit, and the digest
    of its repaired rows (``role:text``, joined by newlines)."""
    key = edits.schema["conv_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        head, audit, sha, empty = None, bytearray(), hashlib.sha256(), True
        for b in batches:
            for conv, step, edit, role, text, *facts in zip(*(c.to_pylist() for c in b.columns)):
                if step == 0:
                    if head:
                        yield *head, audit.decode(), sha.hexdigest()
                    head, audit, sha, empty = (conv, *facts), bytearray(), hashlib.sha256(), True
                    continue
                audit += edit.encode()
                if role is not None:
                    sha.update(f"{'' if empty else chr(10)}{role}:".encode())
                    sha.update(text.encode())
                    empty = False
        if head:
            yield *head, audit.decode(), sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def again():
            yield first
            yield from batches

        kinds = [first.schema.field(0).type, *[pa.int64()] * len(FACTS), pa.string(), pa.string()]
        yield from batched(rows(again()), ["conv_id", *FACTS, "audit", "repaired_sha256"], kinds, lambda r: len(r[-2]))

    return edits.mapInArrow(run, f"conv_id {key}, {', '.join(f'{f} bigint' for f in FACTS)}, audit string, repaired_sha256 string")
