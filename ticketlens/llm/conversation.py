"""Repair of the turn structure of conversations by a cheapest edit script.

Every row of a conversation is kept (0), given another role (1) or deleted (2); a turn without text can be inserted anywhere (5). The
roles' initials must then read ``(s?(ua)+)?``. Four states follow the output: nothing yet, after a system turn, after a user turn, after an
assistant turn (first and last of these may end it). Blank rows and repeats of an earlier row must go, a truncated row that
stays costs 5 more. The audit is the string of the edits' initials (D, I, K, R); of the cheapest scripts the one with the least audit counts.

Hirschberg's divide and conquer finds it in linear space: costs go forward to the middle of a conversation and backward to it, four
numbers each, and the crossing state with the least sum is on a cheapest script. Inserts are counted with the row they
precede, so two audits of the same rows never are one the beginning of the other, and comparing whole audits is comparing their
beginnings first: the forward pass carries each state's place in the order of audits, and of equal sums the crossing
with the least place is taken. Then both halves go on by themselves. All conversations of a batch go through these passes side by side.

Rows are dealt by a range exchange on (conversation, turn, ...), so a conversation with most of all rows lies in many
partitions. Each partition is a stream of sorted rows: conversations that begin and end in it, with at most ``PART_ROWS`` rows, are repaired at
once. What is longer or reaches over an edge becomes parts. A part is summed up by four by four costs, parts of a conversation
meet in one small group, where the same forward and backward vectors choose the states at all edges of parts, and every part is
then repaired between its own two states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import extended, stored

PART_ROWS = 4096
PART_BYTES = 4 << 20
_WHITE = " \t\n\x0b\f\r"

# -- the edit model ----------------------------------------------------------------------------------------------------

STATES = 4                      # nothing, system, user, assistant
_EXPECTS = (1, 1, 2, 1)         # the initial that may follow a state, as a role number (1 user, 2 assistant)
_INSERTED = ("", "", "user", "assistant")
_ENDS = (0, 3)
_NONE = 1 << 40                 # cost of what is impossible
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
_INITIAL = {"s": 0, "u": 1, "a": 2}
#: Kinds of row: 3 * (role 0..3) + (0 plain, 1 truncated, 2 must go); 12 is a row that is not there.
ABSENT = 12
KINDS = 13


def _insert_runs(state: int) -> list[tuple[str, int]]:
    """(audit, state) after inserts alone; more of them would come back to a state."""
    out, seen = [("", state)], {state}
    while True:
        state = 3 if _EXPECTS[state] == 2 else 2
        if state in seen:
            return out
        seen.add(state)
        out.append((out[-1][0] + "I", state))


def _steps() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """cost[kind, from, to], piece[kind, from, to] of the best way to handle one row, and the pieces, sorted."""
    best: dict[tuple[int, int, int], tuple[int, str]] = {}

    def offer(kind, a, b, cost, audit):
        best[kind, a, b] = min(best.get((kind, a, b), (_NONE, "~")), (cost, audit))

    for a in range(STATES):
        offer(ABSENT, a, a, 0, "")
        for inserts, s in _insert_runs(a):
            paid = INSERT * len(inserts)
            for kind in range(ABSENT):
                role, fault = divmod(kind, 3)
                offer(kind, a, s, paid + DELETE, inserts + "D")
                if fault == 2:
                    continue
                paid_row = paid + (CUT if fault else 0)
                to = 3 if _EXPECTS[s] == 2 else 2
                if role == _EXPECTS[s]:
                    offer(kind, a, to, paid_row + KEEP, inserts + "K")
                if role == 0 and s == 0:
                    offer(kind, a, 1, paid_row + KEEP, inserts + "K")
                offer(kind, a, to, paid_row + REROLE, inserts + "R")
    pieces = sorted({audit for _, audit in best.values()})
    cost = np.full((KINDS, STATES, STATES), _NONE, np.int64)
    piece = np.zeros((KINDS, STATES, STATES), np.int64)
    for key, (c, audit) in best.items():
        cost[key], piece[key] = c, pieces.index(audit)
    return cost, piece, pieces


COST, PIECE, PIECES = _steps()
_END = [min((run for run in _insert_runs(s) if run[1] in _ENDS), key=lambda run: len(run[0])) for s in range(STATES)]
END_COST = np.array([INSERT * len(run) for run, _ in _END], np.int64)
assert len(PIECES) < 32


def forward(kinds: np.ndarray, begin: np.ndarray, size: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of every state after rows begin .. begin + size of each lane, from the lanes' costs by state, and the place of
    its audit among the four states' audits."""
    place = np.zeros_like(cost)
    order = np.argsort(-size, kind="stable")      # lanes that are through are a tail
    cost, place, begin, size = cost[order], place[order], begin[order], size[order]
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, "left"))
        kind = kinds[begin[:live] + k]
        # one number: cost, then the audit so far, then the audit of this row
        way = (cost[:live, :, None] + COST[kind]) * 128 + place[:live, :, None] * 32 + PIECE[kind]
        way = way.min(axis=1)
        cost[:live] = np.minimum(way >> 7, _NONE)
        tie = np.where(way >> 7 >= _NONE, 128, way & 127)
        place[:live] = (tie[:, None, :] < tie[:, :, None]).sum(axis=2)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return cost[back], place[back]


def backward(kinds: np.ndarray, begin: np.ndarray, size: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Least cost from every state before rows begin .. begin + size of each lane, given the costs after them."""
    order = np.argsort(-size, kind="stable")
    cost, begin, size = cost[order], begin[order], size[order]
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, "left"))
        kind = kinds[begin[:live] + size[:live] - 1 - k]
        cost[:live] = np.minimum((COST[kind] + cost[:live, None, :]).min(axis=2), _NONE)
    out = np.empty_like(cost)
    out[order] = cost
    return out


def _only(state: np.ndarray) -> np.ndarray:
    out = np.full((len(state), STATES), _NONE, np.int64)
    out[np.arange(len(state)), state] = 0
    return out


def crossing(ahead: np.ndarray, place: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The state of each lane on a cheapest script; of several the one with the least audit."""
    total = ahead + behind
    return np.where(total == total.min(axis=1, keepdims=True), place, STATES).argmin(axis=1)


def hirschberg(kinds: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Piece of every row of each lane, on the best script from state ``first`` to state ``last``."""
    piece = np.zeros(len(kinds), np.int64)
    live = size > 0
    begin, size, first, last = begin[live], size[live], first[live], last[live]
    while len(begin):
        one = size == 1
        piece[begin[one]] = PIECE[kinds[begin[one]], first[one], last[one]]
        begin, size, first, last = begin[~one], size[~one], first[~one], last[~one]
        if not len(begin):
            break
        half = size // 2
        ahead, place = forward(kinds, begin, half, _only(first))
        middle = crossing(ahead, place, backward(kinds, begin + half, size - half, _only(last)))
        begin, size = np.r_[begin, begin + half], np.r_[half, size - half]
        first, last = np.r_[first, middle], np.r_[middle, last]
    return piece


def best_end(kinds: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The state each whole conversation best ends its rows in, before closing inserts."""
    ahead, place = forward(kinds, begin, size, _only(np.zeros(len(begin), np.int64)))
    return crossing(ahead, place, np.broadcast_to(END_COST, ahead.shape))


# -- rows --------------------------------------------------------------------------------------------------------------

_EDIT = pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
EDIT_TYPE = T.ArrayType(T.StructType([T.StructField("edit", T.StringType()), T.StructField("turn", T.LongType()),
                                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_STREAM = ["conv", "turn", "role", "text", "present"]


def kind_of(role: str, text: str) -> int:
    """The kind of a row, repeats left aside."""
    low = text.strip(_WHITE)
    return 3 * _INITIAL.get(role[:1], 3) + (2 if not low else int(low[-1] not in ".!?"))


def _edits(kinds, piece, roles, texts, turns, state: int, end: int | None) -> tuple[list[dict], int]:
    """The edits of one run of rows from ``state`` on (``end``: the whole script's end, closing inserts follow), and their cost."""
    out, paid = [], 0
    for k in range(len(kinds)):
        for letter in PIECES[piece[k]] if kinds[k] != ABSENT else "":
            if letter == "D":
                out.append({"edit": "D", "turn": turns[k], "role": None, "text": None})
                paid += DELETE
                continue
            to = 3 if _EXPECTS[state] == 2 else 2
            if letter == "I":
                out.append({"edit": "I", "turn": None, "role": _INSERTED[to], "text": ""})
                paid += INSERT
            else:
                if letter == "K" and kinds[k] // 3 == 0:
                    to = 1
                out.append({"edit": letter, "turn": turns[k], "role": roles[k] if letter == "K" else _INSERTED[to], "text": texts[k]})
                paid += (REROLE if letter == "R" else KEEP) + (CUT if kinds[k] % 3 == 1 else 0)
            state = to
    if end is not None:
        for _ in _END[end][0]:
            state = 3 if _EXPECTS[state] == 2 else 2
            out.append({"edit": "I", "turn": None, "role": _INSERTED[state], "text": ""})
            paid += INSERT
    return out, paid


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def _gaps(turns: list) -> int:
    known = [t for t in turns if t is not None]
    return _as_long(max(known) - min(known) + 1 - len(set(known))) if known else 0


def _as_long(n: int) -> int:
    """The number as a 64-bit one; beyond that it wraps, as Spark's does."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


class _Stream:
    """Conversations of one partition's sorted rows: whole ones are repaired, others come out as parts."""

    def __init__(self, conv_type: pa.DataType, part_rows: int):
        self.conv_type, self.part_rows = conv_type, part_rows
        self.rows: list[list] = [[], [], [], []]      # turn, role, text, present of the conversation at hand
        self.conv, self.bytes, self.seen_any = None, 0, False
        self.open = True                                # it may have begun before this partition
        self.seq = 0
        self.whole, self.held = [], 0

    def add(self, conv, turn, role, text, present) -> Iterator[pa.RecordBatch]:
        if not self.seen_any or conv != self.conv:
            if self.seen_any:
                yield from self.close(last=False)
                self.open = False
            self.conv, self.seen_any, self.seq = conv, True, 0
        for column, value in zip(self.rows, (turn, role, text, present), strict=True):
            column.append(value)
        self.bytes += len(text or "")
        if len(self.rows[0]) >= self.part_rows or self.bytes >= PART_BYTES:
            self.open = True
            yield self.part()

    def close(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.open or last:
            if self.rows[0]:
                yield self.part()
            return
        self.whole.append((self.conv, *self.rows))
        self.held += len(self.rows[0]) + self.bytes // 256
        self.rows, self.bytes = [[], [], [], []], 0
        if self.held >= 2 * PART_ROWS:
            yield self.repaired()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.seen_any:
            yield from self.close(last=True)
        if self.whole:
            yield self.repaired()

    def part(self) -> pa.RecordBatch:
        """The rows at hand as an unfinished part: one output row with its rows in it."""
        turns, roles, texts, present = self.rows
        rows = [{"edit": None if p else "-", "turn": t, "role": r, "text": x} for t, r, x, p in zip(turns, roles, texts, present, strict=True)]
        self.rows, self.bytes = [[], [], [], []], 0
        self.seq += 1
        return self.batch([(self.conv, self.seq, rows, [0] * len(COUNTS))])

    def repaired(self) -> pa.RecordBatch:
        whole, self.whole, self.held = self.whole, [], 0
        kinds, begin, size, kept = [], [], [], []
        for conv, turns, roles, texts, present in whole:
            here = [k for k, p in enumerate(present) if p]
            turns, roles, texts = ([c[k] for k in here] for c in (turns, roles, texts))
            begin.append(len(kinds))
            seen, faults = set(), []
            for r, x in zip(roles, texts, strict=True):
                kind = kind_of(r, x)
                again = kind % 3 != 2 and (r, x) in seen
                seen.add((r, x))
                faults.append("duplicate" if again else ("", "truncated", "blank")[kind % 3])
                kinds.append(kind - kind % 3 + 2 if again else kind)
            size.append(len(here))
            kept.append((conv, turns, roles, texts, faults))
        kinds, begin, size = np.array(kinds, np.int64), np.array(begin, np.int64), np.array(size, np.int64)
        end = best_end(kinds, begin, size)
        piece = hirschberg(kinds, begin, size, np.zeros(len(begin), np.int64), end)
        out = []
        for (conv, turns, roles, texts, faults), a, n, e in zip(kept, begin.tolist(), size.tolist(), end.tolist(), strict=True):
            edits, paid = _edits(kinds[a: a + n].tolist(), piece[a: a + n].tolist(), roles, texts, turns, 0, e)
            out.append((conv, 0, edits, [_gaps(turns), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), _illegal(roles), paid]))
        return self.batch(out)

    def batch(self, out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([o[0] for o in out], self.conv_type), pa.array([o[1] for o in out], pa.int64()),
                   pa.array([o[2] for o in out], pa.list_(_EDIT))]
        columns += [pa.array([o[3][k] for o in out], pa.int64()) for k in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays(columns, names=["conv", "part", "edits", *COUNTS])


def _streamed(part_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None
        for batch in batches:
            if stream is None:
                stream = _Stream(batch.schema.field("conv").type, part_rows)
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                for row in zip(*(piece.column(c).to_pylist() for c in range(5)), strict=True):
                    yield from stream.add(*row)
        if stream is not None:
            yield from stream.end()

    return run


# -- parts -------------------------------------------------------------------------------------------------------------


def _part_kinds(edits: pa.Array, first: list[list[bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of the rows of each part; ``first``: whether a row's role and text are seen for the first time."""
    kinds, begin, size = [], [], []
    for rows, fresh in zip(edits.to_pylist(), first, strict=True):
        begin.append(len(kinds))
        size.append(len(rows))
        for row, new in zip(rows, fresh, strict=True):
            kind = ABSENT if row["edit"] == "-" else kind_of(row["role"], row["text"])
            kinds.append(kind if kind == ABSENT or new else kind - kind % 3 + 2)
    return np.array(kinds, np.int64), np.array(begin, np.int64), np.array(size, np.int64)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's least costs and audit places between any two states, counts, first and last role and turn."""
    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            rows = one.column(1).to_pylist()[0]
            kinds, begin, size = _part_kinds(one.column(1), one.column(2).to_pylist())
            start = np.arange(STATES)
            cost, place = forward(kinds, np.repeat(begin, STATES), np.repeat(size, STATES), _only(start))
            there = [r for r in rows if r["edit"] != "-"]
            turns = [r["turn"] for r in there if r["turn"] is not None]
            plain = [kind_of(r["role"], r["text"]) % 3 if r["edit"] != "-" else 0 for r in rows]
            fresh = one.column(2).to_pylist()[0]
            blank = sum(f == 2 for f in plain)
            again = sum(f != 2 and not n and r["edit"] != "-" for f, n, r in zip(plain, fresh, rows, strict=True))
            cut = sum(f == 1 and n for f, n in zip(plain, fresh, strict=True))
            yield pa.RecordBatch.from_arrays(
                [one.column(0), pa.array([cost.ravel().tolist()], pa.list_(pa.int64())), pa.array([place.ravel().tolist()], pa.list_(pa.int64())),
                 *(pa.array([x], pa.int64()) for x in (blank, again, cut, _illegal([r["role"] for r in there]), len(set(turns)))),
                 *(pa.array([x], pa.int64()) for x in (min(turns, default=0), max(turns, default=0))),
                 *(pa.array([x], pa.string()) for x in (there[0]["role"][:1] if there else None, there[-1]["role"][:1] if there else None))],
                names=["line", "costs", "places", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "head", "tail"])


_SUMMARY = ("line long, costs array<long>, places array<long>, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
            "head string, tail string")


def _edges(parts: pd.DataFrame) -> pd.DataFrame:
    """States at the edges of the parts of one conversation, a row of numbers per part; counts of the whole on the first one."""
    parts = parts.sort_values("line", kind="stable")
    n = len(parts)
    cost = np.stack([np.array(c, np.int64).reshape(STATES, STATES) for c in parts["costs"]])
    place = np.stack([np.array(c, np.int64).reshape(STATES, STATES) for c in parts["places"]])
    behind = np.empty((n + 1, STATES), np.int64)
    behind[n] = END_COST
    for k in range(n - 1, -1, -1):
        behind[k] = np.minimum((cost[k] + behind[k + 1]).min(axis=1), _NONE)
    state, edges = 0, [0]
    for k in range(n):      # parts' audits are never one the beginning of the other, so the least comes first
        state = int(crossing(cost[k][state][None], place[k][state][None], behind[k + 1][None])[0])
        edges.append(state)
    turns, illegal, high, tail = 0, 0, None, None
    low = None
    for p in parts.itertuples():
        if p.turns:
            turns += int(p.turns) - int(high is not None and p.low == high)
            low, high = p.low if low is None else low, p.high
        if isinstance(p.head, str):
            illegal += int(tail is not None and tail + p.head not in ("su", "ua", "au"))
            tail = p.tail
    out = pd.DataFrame({"line": parts["line"], "first": edges[:-1], "last": edges[1:], "is_end": [False] * (n - 1) + [True], "number": range(1, n + 1),
                        "gaps": 0, "blank": parts["blank"], "duplicate": parts["duplicate"], "truncated": parts["truncated"],
                        "illegal": parts["illegal"]})
    if low is not None:
        out.iloc[0, out.columns.get_loc("gaps")] = _as_long(int(high) - int(low) + 1 - turns)
    out.iloc[0, out.columns.get_loc("illegal")] += illegal
    return out


_EDGES = "line long, first int, last int, is_end boolean, number long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts between their two states: conv, number, edits, counts."""
    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            row = {f.name: one.column(i).to_pylist()[0] for i, f in enumerate(batch.schema) if f.name != "conv"}
            kinds, begin, size = _part_kinds(one.column(batch.schema.get_field_index("edits")), [row["fresh"]])
            piece = hirschberg(kinds, begin, size, np.array([row["first"]]), np.array([row["last"]]))
            rows = row["edits"]
            edits, paid = _edits(kinds.tolist(), piece.tolist(), [r["role"] for r in rows], [r["text"] for r in rows], [r["turn"] for r in rows],
                                 row["first"], row["last"] if row["is_end"] else None)
            yield pa.RecordBatch.from_arrays(
                [one.column(batch.schema.get_field_index("conv")), pa.array([row["number"]], pa.int64()), pa.array([edits], pa.list_(_EDIT)),
                 *(pa.array([row[c]], pa.int64()) for c in COUNTS[:-1]), pa.array([paid], pa.int64())],
                names=["conv", "part", "edits", *COUNTS])


# -- operators ---------------------------------------------------------------------------------------------------------


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present: Column | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv, part, edits, gaps, blank, duplicate, truncated, illegal, cost): the repaired conversations.

    ``edits`` holds, in order, the edits (edit, turn, role, text after it; a deleted row has neither role nor text). A conversation is one
    row with part 0, or, if it has more than ``part_rows`` rows or lies at the edge of a partition, rows with part 1, 2, ..., whose edits
    follow each other and whose numbers add up. Rows come by turn (nulls first), then by role, text hash and text; null roles and texts are one
    space, null conversations are one conversation, other columns are not read. Rows for which ``present`` is not true only
    keep their conversation in the result (no edits and zeros where no other row is left). Texts are handled as they are, however long; a conversation of
    many rows is never in one task, but for the audit places of its parts. Numbers: ``gaps`` turns missing between the first and last one,
    ``blank``, ``duplicate`` and ``truncated`` first faults of rows, ``illegal`` neighbours whose initials are not su, ua or au, ``cost`` of
    all edits. An empty table gives an empty one.
    """
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    some = F.lit(" ")
    lined = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        F.when(there, F.coalesce(F.col(f"`{role_col}`"), some)).alias("role"),
                        F.when(there, F.coalesce(F.col(f"`{text_col}`"), some)).alias("text"), there.alias("present"),
                        F.monotonically_increasing_id().alias("line"))
    keys = [F.col("conv"), F.col("turn"), F.col("role"), F.xxhash64("text"), F.col("line")]
    dealt = lined.repartitionByRange(*keys).sortWithinPartitions("conv", "turn", "role", F.xxhash64("text"), "text", "line")
    schema = extended(lined.select("conv").schema, part="long", edits=EDIT_TYPE, **{c: "long" for c in COUNTS})
    out = stored(dealt.select(*_STREAM).mapInArrow(_streamed(part_rows), schema)
                 .withColumn("line", F.monotonically_increasing_id()), "conversation-rows")      # parts in the order of the rows
    whole = out.where("part = 0").drop("line")
    parts = out.where("part > 0").select("conv", "line", "edits")
    # the first place of every role and text, over all parts of a conversation
    texts = parts.select("conv", "line", F.posexplode("edits").alias("k", "row")).where("row.edit is null")
    mark = F.sha2(F.concat(F.sha2(F.col("row.role").cast("binary"), 256), F.col("row.text")).cast("binary"), 256)
    firsts = texts.groupBy("conv", mark.alias("mark")).agg(F.min(F.struct("line", "k")).alias("at"))
    firsts = firsts.groupBy(F.col("at.line").alias("of")).agg(F.collect_list("at.k").alias("new"))      # at most part_rows in a part
    marked = parts.join(firsts, F.col("line") == F.col("of"), "left")
    fresh = F.transform(F.sequence(F.lit(0), F.size("edits") - 1), lambda k: F.array_contains(F.coalesce("new", F.array().cast("array<int>")), k))
    marked = stored(marked.select("conv", "line", "edits", fresh.alias("fresh")), "conversation-parts")
    sums = marked.select("line", "edits", "fresh").mapInArrow(_summaries, _SUMMARY)
    # narrow: numbers per part of thousands of rows
    of = marked.select("conv", F.col("line").alias("of"))
    edges = sums.join(of, F.col("line") == F.col("of")).drop("of").groupBy("conv").applyInPandas(_edges, _EDGES)
    joined = marked.join(edges.withColumnRenamed("line", "of"), F.col("line") == F.col("of")).drop("of", "line")
    return whole.unionByName(joined.mapInArrow(_finish, schema))


def audit(edits: str | Column = "edits") -> Column:
    return F.array_join(F.transform(edits, lambda e: e["edit"]), "")


def lines(edits: str | Column = "edits") -> Column:
    """``role:text`` of the rows that are left."""
    return F.transform(F.filter(edits, lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))


def digest(repaired: DataFrame) -> DataFrame:
    """A row per conversation: conv, the numbers, audit and repaired_sha256, the hash of the left rows' ``role:text``, joined by newlines.

    A hash runs over a text from end to end, so a conversation of several parts goes through one task, part by part.
    """
    numbers = [F.sum(c).cast("long").alias(c) for c in COUNTS]
    short = repaired.where("part = 0").select(
        "conv", *COUNTS, audit().alias("audit"), F.sha2(F.array_join(lines(), "\n").cast("binary"), 256).alias("repaired_sha256"))
    parts = repaired.where("part > 0")
    script = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", audit().alias("a")))), lambda x: x["a"]), "")
    summed = parts.groupBy("conv").agg(*numbers, script.alias("audit"))
    schema = extended(parts.select(F.col("conv").alias("of")).schema, repaired_sha256="string")
    hashed = (parts.select("conv", "part", lines().alias("lines")).repartition("conv").sortWithinPartitions("conv", "part")
              .mapInArrow(_hashed, schema))
    out = summed.join(hashed, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    return short.unionByName(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conversation, hash) of sorted parts, one line at a time."""
    conv, state, empty, kind = None, None, True, None
    for batch in batches:
        kind = batch.schema.field("conv").type

        def done(conv, state, kind=kind):
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], names=["of", "repaired_sha256"])

        for at in range(batch.num_rows):
            own = batch.column(0)[at].as_py()
            if state is None or own != conv:
                if state is not None:
                    yield done(conv, state)
                conv, state, empty = own, hashlib.sha256(), True
            for line in batch.column(2)[at].as_py():
                state.update((line if empty else "\n" + line).encode())
                empty = False
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], names=["of", "repaired_sha256"])


# -- damage ------------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) of ``conversations`` damaged by crc32(``conv_id:turn``) % 20, nulls being one space: 0 drops the
    row (present is false), 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user's."""
    some = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), some), F.lit(":"), F.coalesce(F.col("turn").cast("string"), some))
    role, text = F.coalesce("role", some), F.coalesce("text", some)
    how = F.crc32(name.cast("binary")) % 20
    return (rows.withColumn("how", how)
            .select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(role).alias("role"),
                    F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                    (F.col("how") != 0).alias("present"),
                    F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))
