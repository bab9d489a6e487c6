"""Repair of conversations: the cheapest edits after which roles alternate as they should.

Rows are dealt by conversation and sorted by turn within tasks; a task streams over them, Arrow
batch by batch, and carries the state of a dynamic program.  Its states say what the repaired roles
end with: nothing, a system turn, a user turn or an assistant turn.  For each state the program
knows the cheapest way there, ties broken by the least string of edits, and leaves one byte of
backpointer for a row and state: how many turns are inserted before the row, what happens to the
row, and from which state.  At the end of a conversation the backpointers are walked back and the
repaired turns come out in order.  Backpointers and rows of a conversation that outgrows the memory
allotted to it go to a temporary file of the task, which is gone when the task ends, however it does.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.shipping import ship_by_value

ship_by_value(__name__)

#: What repaired roles can end with, and where a turn of each role leads; a repaired conversation ends in NOTHING or ASSISTANT.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The one role that can be put after each state.
_FILL = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_NAMES = {"D": "delete", "I": "insert", "K": "keep", "R": "rerole"}
_COST = {"K": 0, "R": 2, "D": 3, "I": 2}
#: A state dearer by more than this than the cheapest cannot win any more: its turns can be matched by few deletions and insertions.
_HOPELESS = 12
#: Turns inserted in a row, at most; a third would have to be undone.
_INSERTS = 2
#: Bytes of rows, and rows, of one conversation that a task keeps in memory.
HELD_BYTES, HELD_ROWS = 8 << 20, 20_000

_TURNS = "conv_id bigint, position bigint, turn bigint, role string, text string, edit string, fault string, given_role string, next_turn boolean, illegal boolean"


def _moves(kind: str) -> list[tuple[int, int, str, int]]:
    """(state before, state after, edits, cost) for a row: `kind` is its role's initial, if any, and 't' for truncated; 'x' must be deleted."""
    out = []
    for start in range(4):
        state = start
        for n in range(_INSERTS + 1):
            fills = "I" * n
            out.append((start, state, fills + "D", 2 * n + 3))
            if kind != "x":
                dearer = 2 * n + kind.endswith("t")
                if state in _NEXT.get(kind[0], {}):
                    out.append((start, _NEXT[kind[0]][state], fills + "K", dearer))
                out.append((start, _FILL[state], fills + "R", dearer + 2))
            state = _FILL[state]
    return out


_KINDS = ("x", "s", "st", "u", "ut", "a", "at", "-", "-t")
_EDITS = [("I" * n) + e for n in range(_INSERTS + 1) for e in "DKR"]


@cache
def _step(ways: tuple, kind: str) -> tuple[tuple, int, bytes]:
    """The ways to each state after a row: ways before are (cost above the cheapest, rank among equals by edits) or
    None; result: ways after, cost of the cheapest, a byte of backpointer for each state."""
    best: list = [None] * 4
    for start, state, edits, cost in _MOVES[kind]:
        if ways[start] is not None:
            found = ways[start][0] + cost, ways[start][1], edits, start
            if best[state] is None or found[:3] < best[state][:3]:
                best[state] = found
    least = min(b[0] for b in best if b)
    order = sorted((b[1], b[2]) for b in best if b)
    after = tuple((b[0] - least, order.index((b[1], b[2]))) if b and b[0] - least <= _HOPELESS else None for b in best)
    return after, least, bytes(_EDITS.index(b[2]) << 2 | b[3] if b else 255 for b in best)


_MOVES = {kind: _moves(kind) for kind in _KINDS}
_START = ((0, 0), None, None, None)


def _ending(ways: tuple) -> tuple[int, str]:
    """The state before the last insertions, and these."""
    found = []
    for start in range(4):
        state = start
        for n in range(_INSERTS + 1):
            if ways[start] is not None and state in (NOTHING, ASSISTANT):
                found.append((ways[start][0] + 2 * n, ways[start][1], "I" * n, start))
            state = _FILL[state]
    # Of equal cost, the rank decides; a way and the same way with more insertions never cost the same.
    _, _, fills, state = min(found)
    return state, fills


class _Conversation:
    """One conversation while its rows stream by."""

    def __init__(self, key):
        self.key, self.ways, self.n, self.last = key, _START, 0, None
        self.back, self.tables, self.bytes, self.rows = [], [], 0, 0
        self.back_file = self.row_file = self.writer = None

    def add(self, rows: pa.RecordBatch, kinds: list[str]) -> None:
        for kind in kinds:
            self.ways, _, pointers = _step(self.ways, kind)
            self.back.append(pointers)
        self.tables.append(rows)
        self.bytes += rows.nbytes
        self.rows += rows.num_rows
        self.n += rows.num_rows
        if self.bytes > HELD_BYTES or self.rows > HELD_ROWS:
            self._spill()

    def _spill(self) -> None:
        if self.row_file is None:
            self.back_file, self.row_file = tempfile.TemporaryFile(), tempfile.TemporaryFile()
            self.writer = pa.ipc.new_stream(self.row_file, self.tables[0].schema)
        for rows in self.tables:
            self.writer.write_batch(rows)
        self.back_file.write(b"".join(self.back))
        self.back, self.tables, self.bytes, self.rows = [], [], 0, 0

    def edits(self) -> tuple[np.ndarray, str]:
        """For each row the edits that end with its own, as a place in _EDITS, and the insertions after the last row."""
        state, fills = _ending(self.ways)
        if self.row_file is not None:
            self._spill()
            self.back_file.flush()
            back = np.memmap(self.back_file, np.uint8, "r", shape=(self.n, 4))
        else:
            back = np.frombuffer(b"".join(self.back), np.uint8).reshape(-1, 4)
        out = np.empty(self.n, np.uint8)  # one byte a row
        for start in range(self.n, 0, -65_536):
            low = max(0, start - 65_536)
            part = back[low:start].tolist()
            for i in range(start - low - 1, -1, -1):
                pointer = part[i][state]
                out[low + i], state = pointer >> 2, pointer & 3
        return out, fills

    def given(self) -> Iterator[pa.RecordBatch]:
        if self.row_file is None:
            yield from self.tables
        else:
            self.writer.close()
            self.row_file.seek(0)
            yield from pa.ipc.open_stream(self.row_file)

    def repaired(self) -> Iterator[tuple]:
        """Rows of _TURNS, in order."""
        edits, fills = self.edits()
        state, at, position, last_turn, last_initial = NOTHING, 0, 0, None, None
        for rows in self.given():
            for turn, role, text, fault in zip(*(rows.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                todo = _EDITS[edits[at]]
                for _ in todo[:-1]:
                    state = _FILL[state]
                    yield self.key, position, None, _ROLE[state], "", "insert", None, None, False, False
                    position += 1
                edit, new_role = todo[-1], role
                if edit == "K":
                    state = _NEXT[role[0]][state]
                elif edit == "R":
                    state = _FILL[state]
                    new_role = _ROLE[state]
                initial = role[:1]
                yield (self.key, position, turn, new_role, text, _NAMES[edit], fault, role, turn is not None and turn != last_turn,
                       last_initial is not None and last_initial + initial not in ("su", "ua", "au"))
                last_turn, last_initial, at, position = turn if turn is not None else last_turn, initial, at + 1, position + 1
        for _ in fills:
            state = _FILL[state]
            yield self.key, position, None, _ROLE[state], "", "insert", None, None, False, False
            position += 1
        for file in (self.back_file, self.row_file):
            if file is not None:
                file.close()


def _kinds(rows: pa.RecordBatch) -> list[str]:
    return ["x" if fault in ("blank", "duplicate") else (role[0] if role[:1] in ("s", "u", "a") and role else "-") + ("t" if fault else "")
            for role, fault in zip(rows.column(2).to_pylist(), rows.column(4).to_pylist(), strict=True)]


def _repairer(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def finished(talk: _Conversation) -> Iterator[pa.RecordBatch]:
            nonlocal out, size
            for row in talk.repaired():
                out.append(row)
                size += len(row[4])
                if len(out) >= 5_000 or size > 4 << 20:
                    yield batch_of(out)
                    out, size = [], 0

        talk = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            kinds = _kinds(batch)
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if talk is None or talk.key != key[start]:
                    if talk is not None:
                        yield from finished(talk)
                    talk = _Conversation(key[start])
                talk.add(batch.slice(start, end - start), kinds[start:end])
        if talk is not None:
            yield from finished(talk)
        if out:
            yield batch_of(out)
    return run


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edited turns (conv_id, position, turn, role, text, edit, fault, given_role, next_turn, illegal), in order within each conversation.

    One row per row of `conversations` and one per inserted turn.  `fault` is the first that a row
    has: blank (nothing but ASCII white space), duplicate (role and text as in an earlier row of the
    conversation), truncated (the last other character is none of . ! ?).  `edit` is keep (free),
    rerole to user or assistant (2), delete (3; a must for blank and duplicate rows) or insert an
    empty user or assistant turn (2); a truncated row that stays costs 1 more.  The edits are the
    cheapest after which the roles read nothing or an optional system turn and then pairs of user
    and assistant; of equally cheap ones the least string of initials (D, I, K, R) is taken, and it
    decides the outcome.  Roles count by their first letter; an empty or other role cannot be kept.
    `role` is the role after the edit, `given_role` that of the row, null for inserted turns;
    `next_turn` marks the first row with a turn number, and `illegal` a row whose role does not
    follow the row's before it (su, ua and au do).

    Rows are in order of turn, nulls first, then of role and text, so equal rows stand together.
    Null roles and texts are read as one space, so a null text is blank; a null conv_id is a
    conversation of its own.  Very long texts and conversations of any length are fine: what a task
    holds is bounded.  An empty table gives no rows; other columns are ignored.
    """
    text, role = F.coalesce(F.col(text_col).cast("string"), F.lit(" ")), F.coalesce(F.col(role_col).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    times = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    # One shuffle: rows dealt by conversation are dealt well enough for windows inside conversations.
    judged = rows.repartition("conv_id").withColumn("times", times).withColumn("fault", _fault(F.col("text"), F.col("times") > 1))
    ordered = judged.select("conv_id", "turn", "role", "text", "fault", "times").sortWithinPartitions("conv_id", "turn", "role", "text", "times")
    return ordered.mapInArrow(_repairer([f.split(" ")[0] for f in _TURNS.split(", ")]), _TURNS)


def _fault(text: Column, seen: Column) -> Column:
    ending = F.rtrim(text, F.lit(" \t\n\x0b\f\r"))
    return (F.when(ending == "", "blank").when(seen, "duplicate")
            .when(~F.right(ending, F.lit(1)).isin(".", "!", "?"), "truncated"))


def _summarizer(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, sums = None, None
        none = object()
        key = none

        def closed() -> tuple:
            low, high, turns, blank, duplicate, truncated, illegal, cost, audit, digest, _ = sums
            return key, (high - low + 1 - turns) if turns else 0, blank, duplicate, truncated, illegal, cost, "".join(audit), digest.hexdigest()

        def batch_of() -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6, 8, 9)]
            for conv, turn, role, text, edit, fault, next_turn, illegal in zip(*columns, strict=True):
                if conv != key or key is none:
                    if key is not none:
                        out.append(closed())
                        if len(out) >= 5_000:
                            yield batch_of()
                            out = []
                    key, sums = conv, [None, None, 0, 0, 0, 0, 0, 0, [], hashlib.sha256(), False]
                if turn is not None:
                    sums[0], sums[1] = turn if sums[0] is None else sums[0], turn
                    sums[2] += next_turn
                if fault:
                    sums[3 + ("blank", "duplicate", "truncated").index(fault)] += 1
                sums[6] += illegal
                initial = edit[0].upper()
                sums[7] += _COST[initial] + (fault == "truncated" and initial != "D")
                sums[8].append(initial)
                if initial != "D":
                    sums[9].update((("\n" if sums[10] else "") + f"{role}:{text}").encode())
                    sums[10] = True
        if key is not none:
            out.append(closed())
        if out:
            yield batch_of()
    return run


def summaries(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for the conversations of `repair`'s rows.

    Reads the rows as they come, in order and dealt by conversation, without another shuffle.  `gaps`
    is the last turn less the first plus one less the number of turns, nulls left out; `audit` the
    initials of the edits; the hash is that of `role:text` of what stays, joined by line ends.  A
    conversation without rows has no summary.
    """
    fields = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return turns.mapInArrow(_summarizer([f.split(" ")[0] for f in fields.split(", ")]), fields)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32(`conv_id:turn`) % 20, nulls read as one space:
    0 drops the row, 1 empties its text, 2 removes the characters . ! ?, 3 repeats the row, 4 makes the role user."""
    space = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return (conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy"))


def all_conversations(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """`found` with a row for every conv_id of `conversations`: zeros, no edits and the hash of nothing for those without a summary."""
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    named = found.withColumnRenamed("conv_id", "found_id")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(named, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
