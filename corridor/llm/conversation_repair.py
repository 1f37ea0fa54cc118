"""Operator 12: conversation structure repair by a square-root checkpointed DP.

A conversation is sound if its roles' initials read ``(s?(ua)+)?``.  Its rows
may be kept (cost 0), given the role user or assistant (Rerole, 2), deleted
(3; blank rows and duplicates must be), and rows of empty text may be inserted
(2); a truncated row that stays adds 1.  Of the cheapest edits the sequence of
initials that comes first in ASCII order is taken.

Four states tell all that the past leaves open: nothing yet, after s, after u,
after a.  A cost vector holds the least cost from a place to the end for each.
Vectors are computed backwards; only those at checkpoints are stored, and a
walk forward from the start recomputes one block at a time and follows the
first edit that is tight, that is, loses nothing.

The rows of all conversations are dealt by ranges of their order, so a long
conversation spreads over tasks, and each task cuts what it holds into
segments of at most ``segment`` rows, a byte each.  Segments are the outer
blocks: each yields its min-plus matrix alone, one pass backwards over the
segments' matrices leaves the vectors at their ends (the checkpoints), each
segment is walked from every state it can be entered in, and one pass forward
picks the walk that is entered.  Inside a segment the same is done with
checkpoints every square root of its rows.

Texts are shuffled once, for the digest of the repaired conversation.  SHA-256
takes a conversation's bytes in order, so one task streams them, row by row;
only the audit, a single value of the result, grows with the conversation.

Defined results: a null conv_id is a conversation of its own; nulls in role
and text, and in what is hashed for the damage, read as one space.  Rows go by
turn (nulls first), then by role, the text's first 64 characters and a hash of
the text; repeated rows of one place are duplicates.  A conversation of which
no row is left has zeros, an empty audit and the digest of the empty string.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._native import SPACE, let
from ._store import stored, table

SEGMENT = 1024
FAR = 1 << 60
#: The state that an inserted or reroled row leads to, by state: nothing yet, s, u, a.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: States in which a row of this initial may be kept, and where it leads.
KEEP = {1: {0: 1}, 2: {0: 2, 1: 2, 3: 2}, 3: {2: 3}, 0: {}}
#: A row's code: its initial (0 other, 1 s, 2 u, 3 a) plus these.
GONE, TRUNCATED = 4, 8
#: Costs at the end of a conversation: inserted rows may still close it.
END = (0, 4, 2, 0)
IDENTITY = [[0 if i == j else FAR for i in range(4)] for j in range(4)]


def before(v: tuple, code: int) -> tuple:
    """The cost vector before a row, from the one behind it."""
    c = [3 + x for x in v]
    if not code & GONE:
        extra, keep = (1 if code & TRUNCATED else 0), KEEP[code & 3]
        for s in range(4):
            c[s] = min(c[s], 2 + extra + v[NEXT[s]])
            if s in keep:
                c[s] = min(c[s], extra + v[keep[s]])
    u, a = min(c[2], 2 + c[3]), min(c[3], 2 + c[2])
    return min(c[0], 2 + u), min(c[1], 2 + u), u, a


def matrix(codes: bytes) -> list[int]:
    """Least cost through the rows from each state (4) to each state (4)."""
    rows = []
    for unit in IDENTITY:
        v = tuple(unit)
        for code in reversed(codes):
            v = before(v, code)
        rows.append(v)
    return [min(rows[j][i], FAR) for i in range(4) for j in range(4)]


def times(m: list[int], v: tuple) -> tuple:
    return tuple(min(m[4 * i + j] + v[j] for j in range(4)) for i in range(4))


def walk(codes: bytes, end: tuple, starts: list[int], closes: bool) -> dict[int, tuple[str, int]]:
    """From each state of ``starts``: the tight edits that come first in ASCII
    order, and the state behind them.  ``closes``: the conversation ends here."""
    n, step = len(codes), max(1, isqrt(len(codes)))
    checkpoints, v = {}, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            checkpoints[i // step] = v  # behind the last row of its block
        v = before(v, codes[i])
    at = {s: (s, []) for s in starts}
    for block in range(-(-n // step)):
        lo, hi = block * step, min(n, (block + 1) * step)
        vectors = [checkpoints[block]]
        for i in range(hi - 1, lo - 1, -1):
            vectors.append(before(vectors[-1], codes[i]))
        vectors.reverse()
        for start, (s, out) in at.items():
            for i in range(lo, hi):
                v, w, code = vectors[i - lo], vectors[i - lo + 1], codes[i]
                extra, keep = (1 if code & TRUNCATED else 0), KEEP[code & 3]
                while True:
                    if 3 + w[s] == v[s]:
                        out.append("D")
                    elif 2 + v[NEXT[s]] == v[s]:
                        out.append("I")
                        s = NEXT[s]
                        continue
                    elif s in keep and extra + w[keep[s]] == v[s]:
                        out.append("K")
                        s = keep[s]
                    else:
                        out.append("R")
                        s = NEXT[s]
                    break
            at[start] = (s, out)
    if closes:
        for start, (s, out) in at.items():
            while END[s]:
                out.append("I")
                s = NEXT[s]
            at[start] = (s, out)
    return {start: ("".join(out), s) for start, (s, out) in at.items()}


# --- Spark -----------------------------------------------------------------

ORDER = ["turn", "role", "head", "hash", "row"]
_ID = "conv {0}, turn {1}, role string, head string, hash long, row long"


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the stated damage."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    d = df.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                  (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times_ = F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1)
    return (d.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                     F.explode(F.array_repeat(F.lit(0), times_)))
            .drop("col"))


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` with the flag of the first fault: 1 blank, 2 duplicate, 3 truncated."""
    same = ["conv", "role", "hash", "hash2"]
    first = (rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "row")).alias("first"))
             .where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in same], F.col("first.row").alias("first_row")))
    met = F.lit(True)
    for c in same:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    fault = F.when(F.col("blank"), 1).when(F.col("row") != F.col("first_row"), 2).when(F.col("truncated"), 3).otherwise(0)
    return rows.join(first, met, "left").select("conv", *ORDER, fault.alias("fault"))


def _segments(size: int):
    """Segments of the rows that one task holds in order, with the key of
    their first row and a byte per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, head, codes, conv = None, None, bytearray(), None
        for b in batches:
            schema = b.schema
            cols = [b.column(i).to_pylist() for i in range(7)]
            out = []
            for row in zip(*cols):
                if head is not None and (row[0] != conv or len(codes) == size):
                    out.append((*head, bytes(codes)))
                    head = None
                if head is None:
                    head, conv, codes = row[:6], row[0], bytearray()
                initial = {"s": 1, "u": 2, "a": 3}.get(row[2][:1], 0)
                codes.append(initial + (GONE if row[6] in (1, 2) else TRUNCATED if row[6] == 3 else 0))
            if out:
                yield _batch(out, schema)
        if head is not None:
            yield _batch([(*head, bytes(codes))], schema)

    def _batch(rows, schema):
        kinds = [schema.field(i).type for i in range(6)] + [pa.binary()]
        names = [schema.field(i).name for i in range(6)] + ["codes"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _with(name: str, kind: pa.DataType, f):
    """A mapInArrow function that adds a column, computed row by row in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = f()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([made(r) for r in b.to_pylist()], kind)], [*b.schema.names, name])
    return run


def _backward():
    """Segments last first: the vector behind each, and whether it is the last."""
    state = {}

    def made(r):
        if state.get("conv", state) != r["conv"]:
            state.update(conv=r["conv"], v=END)
        v = state["v"]
        state["v"] = times(r["m"], v)
        return {"v": list(v), "last": v is END}
    return made


def _walks():
    def made(r):
        starts = [0] if r["first"] else [0, 1, 2, 3]
        done = walk(r["codes"], tuple(r["end"]["v"]), [s for s in starts], r["end"]["last"])
        return [{"s": s, "edits": e, "out": o} for s, (e, o) in done.items()]
    return made


def _forward():
    state = {}

    def made(r):
        if state.get("conv", state) != r["conv"]:
            state.update(conv=r["conv"], s=0)
        w = next(w for w in r["walks"] if w["s"] == state["s"])
        state["s"] = w["out"]
        return w["edits"]
    return made


class _Report:
    """One conversation, fed with its segments' edits and its rows in order."""

    def __init__(self, conv):
        self.conv, self.hash, self.audit, self.edits, self.at = conv, hashlib.sha256(), [], "", 0
        self.state, self.lines, self.cost, self.fault, self.illegal = 0, 0, 0, [0, 0, 0, 0], 0
        self.initial, self.low, self.high, self.turns, self.turn = None, None, None, 0, None

    def line(self, role: str, text: str):
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def inserts(self):
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.state = NEXT[self.state]
            self.line(ROLE[self.state], "")
            self.cost += 2
            self.at += 1

    def segment(self, edits: str):
        self.inserts()
        self.audit.append(edits)
        self.edits, self.at = edits, 0

    def row(self, turn, role: str, text: str, fault: int):
        self.inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            self.cost += 3
        else:
            self.cost += fault == 3
            if edit == "R":
                self.cost += 2
                self.state = NEXT[self.state]
                role = ROLE[self.state]
            else:
                self.state = {"s": 1, "u": 2, "a": 3}[role[:1]]
            self.line(role, text)

    def seen(self, turn, role: str, fault: int):
        self.fault[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn

    def result(self) -> tuple:
        self.inserts()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.fault[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_RESULT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    now, kind = None, None
    for b in batches:
        kind, out = b.schema.field(0).type, []
        for conv, turn, role, fault, edits, text in zip(*(b.column(i).to_pylist() for i in range(6))):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.result())
                now = _Report(conv)
            if edits is not None:
                now.segment(edits)
            elif role is not None:
                now.seen(turn, role, fault)
                now.row(turn, role, text, fault)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [kind, *kinds])], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(now.result(), [kind, *kinds])], names)


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           every: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) for each conversation of ``df``, and of ``every`` if
    given, a table with the same key column."""
    word = F.regexp_replace("text", SPACE, "")
    t = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), t.alias("text"))
    rows = rows.select("*", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(1), "text").alias("hash2"),
                       (word == "").alias("blank"), let(word, lambda w: (w != "") & ~F.substring(w, -1, 1).isin(".", "!", "?")).alias("truncated"),
                       F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "op12-rows")
    judged = stored(_judged(rows.select("conv", *ORDER, "hash2", "blank", "truncated")), "op12-judged")
    kinds = _ID.format(*(rows.schema[c].dataType.simpleString() for c in ("conv", "turn")))
    key = ["conv", *ORDER]
    # by ranges of the order, so a long conversation spreads over tasks
    cut = (judged.select(*key, "fault").repartitionByRange(*key).sortWithinPartitions(*key)
           .mapInArrow(_segments(segment), f"{kinds}, codes binary"))
    segs = cut.mapInArrow(_with("m", pa.list_(pa.int64()), lambda: lambda r: matrix(r["codes"])), f"{kinds}, codes binary, m array<long>")
    end = "struct<v:array<long>,last:boolean>"
    segs = stored(segs, "op12-segments")
    back = (segs.repartition("conv").sortWithinPartitions(F.asc("conv"), *[F.desc(c) for c in ORDER])
            .mapInArrow(_with("end", pa.struct([("v", pa.list_(pa.int64())), ("last", pa.bool_())]), _backward), f"{kinds}, codes binary, m array<long>, end {end}"))
    heads = segs.groupBy("conv").agg(F.min(F.struct(*ORDER)).alias("h")).select(F.col("conv").alias("_conv"), F.col("h.row").alias("_row"))
    back = back.join(heads, F.col("conv").eqNullSafe(F.col("_conv"))).select(*key, "codes", "end", (F.col("row") == F.col("_row")).alias("first"))
    walks = back.mapInArrow(_with("walks", pa.list_(pa.struct([("s", pa.int32()), ("edits", pa.string()), ("out", pa.int32())])), _walks),
                            f"{kinds}, codes binary, end {end}, first boolean, walks array<struct<s:int,edits:string,out:int>>").select(*key, "walks")
    edits = (walks.repartition("conv").sortWithinPartitions(*key)
             .mapInArrow(_with("edits", pa.string(), _forward), f"{kinds}, walks array<struct<s:int,edits:string,out:int>>, edits string")
             .select(*key, "edits"))
    edits = stored(edits, "op12-edits")
    # a conversation's first row, if it has no other; then each segment's edits before its rows
    all_ids = df.select(F.col(conv_id).alias("conv")) if every is None else every.select(F.col(conv_id).alias("conv"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ORDER]
    ids = all_ids.distinct().select("conv", *none, F.lit(None).cast("int").alias("fault"), F.lit(None).cast("string").alias("edits"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"))
    segs = edits.select(*key, F.lit(None).cast("int").alias("fault"), "edits", F.lit(None).cast("string").alias("text"), F.lit(1).alias("kind"))
    full = (judged.select(*key, "fault").join(rows.select(F.col("row"), "text"), "row")
            .select(*key, "fault", F.lit(None).cast("string").alias("edits"), "text", F.lit(2).alias("kind")))
    return (ids.unionByName(segs).unionByName(full).repartition("conv").sortWithinPartitions("conv", F.col("kind") != 0, *ORDER, "kind")
            .select("conv", "turn", F.when(F.col("kind") == 2, F.col("role")).alias("role"), "fault", "edits", "text")
            .mapInArrow(_reported, _RESULT.format(rows.schema["conv"].dataType.simpleString()))
            .withColumnRenamed("conv_id", conv_id))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), every=rows.select("conv_id"))
