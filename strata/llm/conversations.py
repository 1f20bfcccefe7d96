"""Repair of conversations by a run-length dynamic programme over role and fault symbols.

A row is one symbol: the class of its role's initial (s, u, a or other), in
capitals where the text is truncated, or X where the row has to go.  Equal
consecutive symbols are one run.  The roles' initials must come to
``(s?(ua)+)?``, an automaton of four states: a symbol is a 4 x 4 min-plus matrix
of the cheapest edits (inserts before the row included), a run of n a power of
it, advanced through cached squares.  Going back over the runs gives the costs
still ahead; going forward, the least letter that stays on a cheapest way is
the audit.

How rows travel:

* Light rows (conversation, turn, role, two hashes of role and text, faults) are
  counted by their value before they are shuffled, so repeated rows are one row
  and a run of their number.  The first turn of each (role, text) is an
  aggregate joined back.
* They are range-partitioned by (conversation, turn, ...), so a conversation of
  any length is cut into pieces; each piece is reduced to its runs and counts.
* The texts travel once, to their conversation's task, which has the pieces
  first, solves the programme and hashes the kept texts as they stream past.
  A hash of joined texts is a serial pass, so one conversation's texts meet in
  one task; it holds one Arrow batch of them, the conversation's runs and a
  byte a row for the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.layout import BLANKS

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2  # costs of the edits
FAR = 1 << 60
# States: nothing yet, after s, after u, after a.  The next state by the emitted initial.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
INSERTED = (2, 2, 3, 2)  # the only initial that may be inserted in a state leads there
ENDS = (0, 3)
LONG = 64  # from this length on, a run is parted in halves of known costs


def _inserts() -> list[list[int]]:
    cost = [[0 if p == q else FAR for q in range(4)] for p in range(4)]
    for p in range(4):
        q, c = p, 0
        while cost[p][INSERTED[q]] == FAR:
            q, c = INSERTED[q], c + INSERT
            cost[p][q] = c
    return cost


INSERTS = _inserts()


def times(a, b):
    """The min-plus product of two matrices."""
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def ahead(m, v):
    """The costs ahead of a matrix, from those behind it."""
    return tuple(min(x + v[k] for k, x in enumerate(row)) for row in m)


@lru_cache(None)
def row_edits(symbol: str) -> tuple[tuple[str, int, tuple], ...]:
    """(letter, cost, next states) of the edits of one row but for inserts, letters in ASCII order."""
    edits = [("D", DELETE, (0, 1, 2, 3))]
    if symbol != "X":
        more = int(symbol.isupper())  # truncated and not deleted
        if symbol.lower() in NEXT:
            edits.append(("K", KEEP + more, NEXT[symbol.lower()]))
        edits.append(("R", REROLE + more, INSERTED))
    return tuple(edits)


@lru_cache(None)
def power(symbol: str, k: int):
    """The matrix of 2**k equal rows."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    one = [[FAR] * 4 for _ in range(4)]
    for _, cost, to in row_edits(symbol):
        for p in range(4):
            if to[p] is not None:
                one[p][to[p]] = min(one[p][to[p]], cost)
    return times(INSERTS, one)


def before_run(symbol: str, n: int, v):
    k = 0
    while n:
        if n & 1:
            v = ahead(power(symbol, k), v)
        n, k = n >> 1, k + 1
    return v


AT_END = tuple(min(INSERTS[p][q] for q in ENDS) for p in range(4))


def unroll(symbol: str, n: int, state: int, v, out: list[str]) -> int:
    """Adds the letters of a run to ``out``, given the costs ``v`` behind it; returns the state reached."""
    if symbol == "X":  # deletion is free to come before any insert, and D is the least letter
        out.append("D" * n)
        return state
    if n > LONG:
        first = 1 << (n.bit_length() - 2)
        state = unroll(symbol, first, state, before_run(symbol, n - first, v), out)
        return unroll(symbol, n - first, state, v, out)
    costs = [v]
    for _ in range(n):
        costs.append(ahead(power(symbol, 0), costs[-1]))
    for i in range(n, 0, -1):
        here, behind = costs[i], costs[i - 1]
        while True:
            (_, cost, to), *others = row_edits(symbol)
            if cost + behind[state] == here[state]:
                out.append("D")
                break
            if INSERT + here[INSERTED[state]] == here[state]:
                out.append("I")
                state = INSERTED[state]
                continue
            letter, state = next((x, to[state]) for x, cost, to in others if to[state] is not None and cost + behind[to[state]] == here[state])
            out.append(letter)
            break
    return state


def solve(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """The least cost and the ASCII-least audit of it."""
    if len(runs) <= 64:
        return _solved(tuple(runs))
    return _solve(runs)


@lru_cache(50_000)
def _solved(runs: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    return _solve(runs)


def _solve(runs, block: int = 4_096) -> tuple[int, str]:
    """Costs ahead are kept at the ends of blocks of runs only, and worked out again block by block."""
    v, marks = AT_END, []
    for at in range((len(runs) - 1) // block * block, -1, -block):
        marks.append((at, v))
        for symbol, n in reversed(runs[at:at + block]):
            v = before_run(symbol, n, v)
    cost, state, out = v[0], 0, []
    for at, v in reversed(marks):
        behind = [v]
        for symbol, n in reversed(runs[at + 1:at + block]):
            behind.append(before_run(symbol, n, behind[-1]))
        for (symbol, n), v in zip(runs[at:at + block], reversed(behind), strict=True):
            state = unroll(symbol, n, state, v, out)
    while state not in ENDS:
        out.append("I")
        state = INSERTED[state]
    return cost, "".join(out)


# --- from rows to pieces ---------------------------------------------------

PIECES = "conv_id long, piece int, symbols string, lengths array<long>, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
LEGAL = {"su", "ua", "au"}


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted light rows of one partition to one row a conversation: its runs here, its counts and its ends."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[k]) for n, k in (x.split() for x in PIECES.split(", "))])
    done: list[dict] = []
    now: dict | None = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "copies", "role_class", "blank", "truncated", "first")]
        for conv, turn, copies, role, blank, truncated, first in zip(*columns, strict=True):
            if now is None or now["conv_id"] != conv:
                if now is not None:
                    done.append(now)
                    if len(done) >= 4_096:
                        yield pa.RecordBatch.from_pylist([x | {"symbols": "".join(x["symbols"])} for x in done], schema)
                        done = []
                now = dict(conv_id=conv, piece=number, symbols=[], lengths=[], first_turn=None, last_turn=None, turns=0, blank=0, duplicate=0, truncated=0, illegal=0, first_role=None, last_role=None)
            if not copies:
                continue
            if turn is not None:
                if now["last_turn"] != turn:
                    now["turns"] += 1
                    now["last_turn"] = turn
                if now["first_turn"] is None:
                    now["first_turn"] = turn
            if now["last_role"] is None:
                now["first_role"] = role
            else:
                now["illegal"] += now["last_role"] + role not in LEGAL
            now["illegal"] += copies - 1  # equal initials side by side
            now["last_role"] = role
            if blank:
                now["blank"] += copies
                runs = (("X", copies),)
            else:
                now["duplicate"] += copies - first
                now["truncated"] += first and truncated
                runs = ((role.upper() if truncated else role, int(first)), ("X", copies - first))
            for symbol, n in runs:
                if n and now["symbols"] and now["symbols"][-1] == symbol:
                    now["lengths"][-1] += n
                elif n:
                    now["symbols"].append(symbol)
                    now["lengths"].append(n)
    if now is not None:
        done.append(now)
    if done:
        yield pa.RecordBatch.from_pylist([x | {"symbols": "".join(x["symbols"])} for x in done], schema)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Open:
    """One conversation: its pieces first, then its rows in order."""

    def __init__(self, conv):
        self.conv, self.runs, self.first_turn, self.last_turn, self.turns, self.last_role = conv, [], None, None, 0, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.audit, self.at, self.state, self.hash, self.some = None, 0, 0, hashlib.sha256(), False

    def add(self, x: dict) -> None:
        for symbol, n in zip(x["symbols"], x["lengths"], strict=True):
            if self.runs and self.runs[-1][0] == symbol:
                self.runs[-1] = (symbol, self.runs[-1][1] + n)
            else:
                self.runs.append((symbol, n))
        for k in self.counts:
            self.counts[k] += x[k]
        if x["first_turn"] is not None:
            self.turns += x["turns"] - (x["first_turn"] == self.last_turn)
            self.first_turn = x["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = x["last_turn"]
        if x["first_role"] is not None:
            self.counts["illegal"] += self.last_role is not None and self.last_role + x["first_role"] not in LEGAL
            self.last_role = x["last_role"]

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.some = True

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = solve(self.runs)
            self.runs = []

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = INSERTED[self.state]
            self.put("user" if self.state == 2 else "assistant", "")
            self.at += 1

    def row(self, role: str, initial: str, text: str) -> None:
        self.settle()
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = NEXT[initial][self.state]
            self.put(role, text)
        elif letter == "R":
            self.state = INSERTED[self.state]
            self.put("user" if self.state == 2 else "assistant", text)

    def result(self) -> dict:
        self.settle()
        self.inserts()
        assert self.at == len(self.audit), "rows and audit differ"
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, **self.counts, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.hash.hexdigest()}


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces and rows of whole conversations, sorted, to one row a conversation."""
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in RESULT.split(", "))])
    done: list[dict] = []
    now: _Open | None = None
    for batch in batches:
        convs, whole, roles, initials, texts, copies = (batch.column(c).to_pylist() for c in ("conv_id", "whole", "role", "role_class", "text", "copies"))
        for conv, x, role, initial, text, n in zip(convs, whole, roles, initials, texts, copies, strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.result())
                    if len(done) >= 4_096:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done = []
                now = _Open(conv)
            if x is not None:
                now.add(x)
            else:
                for _ in range(n):
                    now.row(role, initial, text)
    if now is not None:
        done.append(now.result())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def blank(text: Column) -> Column:
    return F.trim(F.translate(text, BLANKS, " " * len(BLANKS))) == ""


def unfinished(text: Column) -> Column:
    return ~F.rtrim(F.translate(text, BLANKS, " " * len(BLANKS))).rlike(r"[.!?]\z")


def damaged(rows: DataFrame) -> DataFrame:
    """The given damage: conv_id, turn, role, text and copies (0: dropped).  A null counts as one space, but for ids and turns that are returned or sorted."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    d = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault"))
    return d.select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, the least cost, its audit and the hash of the repaired rows.

    ``rows`` has conv_id (integer, or null, a conversation of its own), turn,
    role, text and copies (0 for a conversation's row that is gone: the
    conversation stays, with zeros, an empty audit and the hash of nothing).
    Role and text are not null; further columns are left alone.

    Rows go by turn, nulls first; rows of one turn by role, then by a hash of
    role and text, so that ties fall alike on every run.  Repeated rows stand
    side by side.  A role counts by its first character; an empty one and any
    but s, u and a can't be kept, only rerolled or deleted.  An empty table
    gives an empty result.
    """
    initial = F.substring("role", 1, 1)
    d = rows.select(
        "conv_id", "turn", "role", "text", "copies",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("role_class"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(12), "text", "role").alias("h2"))
    order = [F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    light = d.groupBy("conv_id", "turn", "role", "role_class", "h1", "h2", blank(F.col("text")).alias("blank"), unfinished(F.col("text")).alias("truncated")).agg(F.sum("copies").alias("copies"))
    same = ["conv_id", "h1", "h2"]
    earliest = light.filter("copies > 0").groupBy(*same).agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unplaced"))
    e, x = earliest.alias("e"), light.alias("x")
    joined = x.join(e, F.col("x.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("x.h1") == F.col("e.h1")) & (F.col("x.h2") == F.col("e.h2")), "left")
    first = F.col("x.turn").isNull() | (~F.col("e.unplaced") & (F.col("x.turn") == F.col("e.least")))
    flagged = joined.select("x.conv_id", "x.turn", "x.role", "x.h1", "x.h2", "x.copies", "x.role_class", "x.blank", "x.truncated", F.coalesce(first, F.lit(False)).alias("first"))
    cut = flagged.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    parts = cut.mapInArrow(pieces, PIECES)
    whole = F.struct("symbols", "lengths", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role")
    ahead_of = parts.select("conv_id", "piece", whole.alias("whole"))
    texts = d.filter("copies > 0").drop("blank", "truncated")
    both = ahead_of.unionByName(texts, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("piece").asc_nulls_last(), *order)
    return dealt.select("conv_id", "whole", "role", "role_class", "text", "copies").mapInArrow(repaired, RESULT)
