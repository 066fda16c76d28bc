"""Repair of conversations by error-correcting Earley parsing.

A weighted grammar says what roles a conversation may have; error productions delete a row, change its role or insert an empty
one.  Chart items keep the least (cost, audit), so the completed item of the last column tells the cheapest repair, ties by the audit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# role initials: nothing, or s? (ua)+; left-recursive, so that every item begins in the first column
GRAMMAR = {"C": ((), ("T",)), "T": (("H", "u", "a"), ("T", "u", "a")), "H": ((), ("s",))}
NAMES = {"u": "user", "a": "assistant"}  # what rows are reroled to or inserted as
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Two inserted rows lead from any item to where any other is, and a row that only the other could keep can be deleted: an item that
# costs over this more than the cheapest cannot become as cheap again.
SLACK = 2 * INSERT + DELETE
SPACE = r"\x20\x09-\x0D"
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}
ITEMS = [(left, right, dot) for left, rights in GRAMMAR.items() for right in rights for dot in range(len(right) + 1)]
NUMBER = {item: k for k, item in enumerate(ITEMS)}
NEXT = [right[dot] if dot < len(right) else None for _, right, dot in ITEMS]
MOVED = [NUMBER.get((left, right, dot + 1), -1) for left, right, dot in ITEMS]
BEGIN = {left: [NUMBER[left, right, 0] for right in rights] for left, rights in GRAMMAR.items()}
WAITING = {left: [k for k, (_, _, dot) in enumerate(ITEMS) if dot == 0 and NEXT[k] == left] for left in GRAMMAR}
LEFT = [left for left, _, _ in ITEMS]
SETTLE = 256  # audits are cut down to where they differ when they are longer


class Chart:
    """The last column of a chart that is read from left to right.

    An item is a dotted rule that begins in the first column; it holds its least cost, the audit of it (from where the items' audits
    differ; what they share is written off) and a hash of the repaired rows so far, so memory does not grow with the texts.
    """

    def __init__(self) -> None:
        self.shared: list[str] = []
        self.column = self.closed([(0, "", k, None, None) for k in BEGIN["C"]])

    def closed(self, agenda: list[tuple]) -> dict[int, tuple]:
        """Items by number, least first: predicted, completed and inserted ones follow from those found."""
        heap = [(cost, audit, n, k, done, line) for n, (cost, audit, k, done, line) in enumerate(agenda)]
        heapq.heapify(heap)
        pushed, found = len(heap), {}
        while heap:
            cost, audit, _, k, done, line = heapq.heappop(heap)
            if k in found:
                continue
            if line is not None:  # hashed only for items that stay
                done = done.copy() if done else hashlib.sha256()
                done.update(line)
            found[k] = (cost, audit, done)
            awaited, follow = NEXT[k], []
            if awaited is None:
                follow = [(cost, audit, MOVED[w], done, None) for w in WAITING[LEFT[k]]]
            elif awaited in GRAMMAR:  # only in the first column, where items have cost 0
                follow = [(cost, audit, b, done, None) for b in BEGIN[awaited]]
            elif awaited in NAMES:
                follow = [(cost + INSERT, audit + "I", MOVED[k], done, said(NAMES[awaited], b"", done))]
            for c, a, to, d, x in follow:
                if to not in found:
                    heapq.heappush(heap, (c, a, pushed, to, d, x))
                    pushed += 1
        return found

    def read(self, role: str, text: bytes, fault: int) -> None:
        """One more row."""
        agenda, late = [], TRUNCATED if fault == CUT_OFF else 0
        for k, (cost, audit, done) in self.column.items():
            awaited = NEXT[k]
            if awaited in GRAMMAR or awaited is None and LEFT[k] != "C":
                continue  # what these lead to is in the column itself
            agenda.append((cost + DELETE, audit + "D", k, done, None))
            if awaited is None or fault in (BLANK, DUPLICATE):
                continue
            if role[:1] == awaited:
                agenda.append((cost + late, audit + "K", MOVED[k], done, said(role, text, done)))
            elif awaited in NAMES:
                agenda.append((cost + REROLE + late, audit + "R", MOVED[k], done, said(NAMES[awaited], text, done)))
        column = self.closed(agenda)
        most = min(cost for cost, _, _ in column.values()) + SLACK
        self.column = {k: item for k, item in column.items() if item[0] <= most}
        if len(next(iter(self.column.values()))[1]) > SETTLE:
            self.settle()

    def settle(self) -> None:
        audits = [a for _, a, _ in self.column.values()]
        low, high = min(audits), max(audits)
        n = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        self.shared.append(low[:n])
        self.column = {k: (c, a[n:], d) for k, (c, a, d) in self.column.items()}

    def repair(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the cheapest repair."""
        cost, audit, done = min(((c, a, d) for k, (c, a, d) in self.column.items() if NEXT[k] is None and LEFT[k] == "C"), key=lambda x: x[:2])
        return cost, "".join(self.shared) + audit, (done or hashlib.sha256()).hexdigest()


def said(role: str, text: bytes, after) -> bytes:
    """A repaired row as it is hashed, behind a line feed if another stands before it."""
    return (b"\n" if after else b"") + role.encode() + b":" + text


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text), nulls of role and text as a space, damaged by a checksum of their conversation and turn.

    A dropped row stays with a null role, so that its conversation is not lost; ``copy`` tells a repeated row from its first.
    """
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(none("conv_id"), F.lit(":"), none("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(none("text"), "[.!?]", "")).otherwise(none("text"))
    role = F.when(kind == 4, "user").when(kind > 0, none("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), F.when(kind > 0, text).alias("text"), F.explode(copies).alias("copy"))


def fault(text: Column, before: Column) -> Column:
    """The first fault of a row; before tells whether its role and text were there earlier."""
    blank = ~text.rlike(f"[^{SPACE}]")
    return F.when(blank, BLANK).when(before, DUPLICATE).when(~text.rlike(rf"[.!?][{SPACE}]*\z"), CUT_OFF).otherwise(SOUND)


class Conversation:
    """Counts and chart of the rows of a conversation, read one by one."""

    def __init__(self) -> None:
        self.chart, self.faults, self.illegal = Chart(), [0] * 4, 0
        self.last: str | None = None
        self.least = self.most = self.turn = None
        self.turns = 0

    def read(self, turn: int | None, role: str | None, text: str | None, fault: int) -> None:
        if role is None:  # dropped
            return
        if turn is not None and (self.least is None or turn != self.turn):
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.turn = self.most = turn
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + role[:1] not in LEGAL
        self.last = role[:1]
        self.chart.read(role, text.encode(), fault)

    def result(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT_OFF], self.illegal, *self.chart.repair()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id and COLUMNS for each conversation of rows (conv_id, turn, role, text; a null role is a dropped row; copy numbers a
    row that is repeated).

    Rows are taken by turn, nulls first, then by role, text and copy, so rows that tie have a fixed order.  Null is a conv_id like any
    other, without a turn a row counts for no gap, and an empty role, which has no initial, is never kept as it is.  A conversation without rows, or whose rows are all deleted, has an empty repair;
    an empty table gives no rows; other columns are left out.

    One shuffle by conversation; Spark's sorts, which spill, put its rows in order, and they stream through the chart row by row, so
    a conversation of any length takes memory only for its audit, which is its result.  Its hash is of all its rows in turn: one
    conversation cannot be split over tasks.
    """
    together = rows.repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn", "copy")) > 1
    ordered = together.withColumn("fault", F.when(F.col("role").isNotNull(), fault(F.col("text"), earlier)))
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text", "copy").select("conv_id", "turn", "role", "text", "fault")
    kind = rows.schema["conv_id"].dataType
    names = ["conv_id", *[c.split()[0] for c in COLUMNS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out, of = None, None, [], None
        for batch in batches:
            of = batch.schema.field(0).type
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or conv != now:
                    if open_ is not None:
                        out.append((now, *open_.result()))
                    now, open_ = conv, Conversation()
                open_.read(*row)
            if len(out) >= 1024:
                yield packed(out, of)
                out = []
        if open_ is not None:
            out.append((now, *open_.result()))
            yield packed(out, of)

    def packed(out: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        types = [of, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, {COLUMNS}")
