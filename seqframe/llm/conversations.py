"""Repair of the turn structure of conversations by a run-length dynamic programme.

What a repair may do with a turn depends only on its *symbol*: the initial of its role, and whether it is
truncated or must go (blank, or a duplicate). Each symbol is a transition between four states (nothing yet, after
the system turn, after a user, after an assistant) under minimum and addition. Equal neighbours are one run, and a
run moves the costs on through the binary powers of its transition, which are made once per symbol. With the least
costs to the end known, choices are unrolled from the front: the least letter that stays on a cheapest way.

Turns are sorted over the whole table in ranges, so a conversation of any length is many tasks' work. Those that
lie inside a range are done where they are read. Of the others, and of those longer than a chunk, each chunk is one
transition matrix: the chain of matrices, backwards, tells the costs to the end for each chunk; each chunk tells
where it leaves for each state in which it may be entered; the chain of these, forwards, tells how it is entered.
Only the digest of the repaired text must read a long conversation in its order; it streams through one task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, task_count
from . import blocks as B

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: Bytes of text (and 64 for each turn) of a conversation that are worked on together, and of a range of turns.
CHUNK = 4 << 20
RANGE = 32 << 20

# states: nothing yet, after the system turn, after a user, after an assistant
_NEW, _SYSTEM, _USER, _ASSISTANT = range(4)
_FORCED = {_NEW: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_KEEPS = {"s": {_NEW: _SYSTEM}, "u": {_NEW: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}, "": {}}
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
_NEVER = 1 << 40
#: Cost from each state after the last turn: a conversation ends empty or after an assistant.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)

#: Symbols: initial (others are empty), truncated; the last one is what must be deleted.
SYMBOLS = [(initial, cut) for initial in ("s", "u", "a", "") for cut in (False, True)] + [("", None)]
_GONE = len(SYMBOLS) - 1
_NUMBER = {symbol: i for i, symbol in enumerate(SYMBOLS)}


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits that use up a turn: letter, cost, next state."""
    initial, cut = SYMBOLS[symbol]
    out = [("D", DELETE, state)]
    if cut is not None:
        more = TRUNCATED * cut
        out += [("K", more, _KEEPS[initial][state])] if state in _KEEPS[initial] else []
        out.append(("R", REROLE + more, _FORCED[state]))
    return out


def _transition(symbol: int) -> np.ndarray:
    """Least cost from state to state over one turn, with what is inserted before it."""
    out = np.full((4, 4), _NEVER, np.int64)
    for state in range(4):
        at, paid = state, 0
        for _ in range(3):
            for _, cost, after in choices(symbol, at):
                out[state, after] = min(out[state, after], paid + cost)
            at, paid = _FORCED[at], paid + INSERT
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product under minimum and addition; b is a matrix or a column of costs."""
    if b.ndim == 1:
        return np.minimum((a + b).min(axis=1), _NEVER)
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), _NEVER)


_UNIT = np.where(np.eye(4, dtype=bool), 0, _NEVER)
_POWERS: dict[int, list[np.ndarray]] = {i: [_transition(i)] for i in range(len(SYMBOLS))}


def power(symbol: int, bit: int) -> np.ndarray:
    """The transition of 2 ** bit turns of one symbol; at most 64 of them are kept for each."""
    known = _POWERS[symbol]
    while len(known) <= bit:
        known.append(_times(known[-1], known[-1]))
    return known[bit]


def runs(symbols: bytes) -> list[tuple[int, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def before_run(symbol: int, many: int, right: np.ndarray) -> np.ndarray:
    """Costs (a column, or the columns of a matrix) before equal turns, given those behind them."""
    bit = 0
    while many >> bit:
        if many >> bit & 1:
            right = _times(power(symbol, bit), right)
        bit += 1
    return right


def before(symbols: bytes, right: np.ndarray) -> np.ndarray:
    """The same for any turns."""
    for symbol, many in reversed(runs(symbols)):
        right = before_run(symbol, many, right)
    return right


def unrolled(symbols: bytes, entry: int, right: np.ndarray, last: bool) -> tuple[str, int]:
    """The least letters of a cheapest way through the turns from the state ``entry``, and the state behind them."""
    costs = []  # behind each run, from the last one on
    for symbol, many in reversed(runs(symbols)):
        costs.append((right, symbol, many))
        right = before_run(symbol, many, right)
    out, state = [], entry
    for behind, symbol, many in reversed(costs):
        inside = [behind.tolist()]  # costs behind each turn of the run
        for _ in range(many):
            behind = _times(power(symbol, 0), behind)
            inside.append(behind.tolist())
        for here, after in zip(reversed(inside), reversed(inside[:-1])):
            while True:
                cost = here[state]
                able = [("D", DELETE + after[state], state)] if DELETE + after[state] == cost else []
                if not able and INSERT + here[_FORCED[state]] == cost:
                    out.append("I")
                    state = _FORCED[state]
                    continue
                letter, _, state = (able or [(x, c, s) for x, c, s in choices(symbol, state) if c + after[s] == cost])[0]
                out.append(letter)
                break
    while last and END[state]:
        out.append("I")
        state = _FORCED[state]
    return "".join(out), state


class Turns:
    """Some turns of one conversation, one after the other."""

    def __init__(self) -> None:
        self.turns, self.roles, self.texts, self.faults, self.size = [], [], [], [], 0

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        end = text.rstrip(SPACE)
        self.faults.append("b" if not end else "d" if repeated else "t" if end[-1] not in ENDS else "")
        self.size += len(text.encode()) + 64

    def symbols(self) -> bytes:
        return bytes(_GONE if fault in ("b", "d") else _NUMBER[role[:1] if role[:1] in ("s", "u", "a") else "", fault == "t"]
                     for role, fault in zip(self.roles, self.faults))

    def counts(self) -> dict:
        """What can be added up over the parts of a conversation."""
        known = [t for t in self.turns if t is not None]
        pairs = zip(self.roles, self.roles[1:])
        return {"blank": self.faults.count("b"), "duplicate": self.faults.count("d"), "truncated": self.faults.count("t"),
                "illegal": sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in pairs), "distinct": len(set(known)),
                "low": min(known, default=None), "high": max(known, default=None),
                "first": self.roles[0][:1] if self.roles else None, "last": self.roles[-1][:1] if self.roles else None}

    def lines(self, audit: str, state: int) -> list[str]:
        """Repaired turns, ``role:text``."""
        out, at = [], 0
        for letter in audit:
            if letter == "I":
                state = _FORCED[state]
                out.append(f"{_NAMES[state]}:")
                continue
            if letter == "K":
                state = _KEEPS[self.roles[at][:1]][state]
                out.append(f"{self.roles[at]}:{self.texts[at]}")
            elif letter == "R":
                state = _FORCED[state]
                out.append(f"{_NAMES[state]}:{self.texts[at]}")
            at += 1
        return out

    def packed(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(
            pickle.dumps((self.turns, self.roles, self.texts, self.faults, self.size)))

    @staticmethod
    def unpacked(data: bytes) -> Turns:
        out = Turns()
        out.turns, out.roles, out.texts, out.faults, out.size = pickle.loads(
            zstandard.ZstdDecompressor().decompress(bytes(data)))
        return out


def added(a: dict | None, b: dict) -> dict:
    """Counts of two parts that follow each other; both are in the order of their turns."""
    if a is None or a["first"] is None:
        return b
    if b["first"] is None:
        return a
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    out["distinct"] -= a["high"] is not None and a["high"] == b["low"]
    lows, highs = ([x for x in (a[k], b[k]) if x is not None] for k in ("low", "high"))
    return out | {"low": min(lows, default=None), "high": max(highs, default=None), "first": a["first"], "last": b["last"]}


RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string, repaired string")


def _result(counts: dict, cost: int, audit: str, digest: str, text: str | None) -> tuple:
    gaps = 0 if counts["low"] is None else counts["high"] - counts["low"] + 1 - counts["distinct"]
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, digest, text)


def _columns(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with known faults, by crc32 of ``conversation:turn`` modulo 20: 0 drops a turn, 1 empties its text, 2 takes
    its ``[.!?]`` out, 3 repeats it, 4 gives it to the user. Nulls are one space. A dropped turn stays as a row whose
    ``dropped`` is true, so that its conversation is known. Columns: conv_id, turn, role, text, dropped."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    kind = F.crc32(key) % 20
    said, by = (F.coalesce(F.col(c).cast("string"), blank) for c in (text, role))
    return rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(by).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(said, ENDS, "")).otherwise(said).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """Turns sorted by conversation and turn over ranges, each behind a marker if it is the first with its role and text.

    The first of equal turns is found by a partial aggregate and travels as a row of its own, so turns are neither
    joined nor grouped by their text, however often it is said.
    """
    spark = rows.sparkSession
    same = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    kept = cut_lineage(rows.withColumns({"same": same, "row": F.monotonically_increasing_id()}), "turns")
    first = kept.filter(~F.col("dropped")).groupBy("conv", "same").agg(F.min(F.struct("turn", "row")).alias("m"))
    marks = first.select("conv", "m.turn", "same", "m.row", F.lit(0).alias("kind"), F.lit("").alias("role"),
                         F.lit("").alias("text"))
    both = marks.unionByName(kept.select(
        "conv", "turn", "same", "row", F.when(F.col("dropped"), 2).otherwise(1).alias("kind"), "role",
        F.when(F.col("dropped"), F.lit("")).otherwise(F.col("text")).alias("text")))
    size = kept.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    keys = ["conv", "turn", "same", "row", "kind"]
    return both.repartitionByRange(max(task_count(spark), -(-size // RANGE)), *keys[:-1]).sortWithinPartitions(*keys)


_PART = "at long, symbols binary, matrix array<long>, turns binary"


def _read(frames: Iterator[pd.DataFrame], chunk: int, texts: bool) -> Iterator[pd.DataFrame]:
    """Results of conversations that lie inside the range and a chunk; parts of all others."""
    from pyspark import TaskContext
    at, conv, turns, whole, mark, out = TaskContext.get().partitionId() << 32, None, Turns(), False, None, []

    def part() -> tuple:
        symbols = turns.symbols()
        return (conv, *[None] * len(_columns(RESULT)), at, symbols, before(symbols, _UNIT).ravel().tolist(), turns.packed())

    def done() -> tuple:
        symbols = turns.symbols()
        audit, _ = unrolled(symbols, _NEW, END, True)
        text = "\n".join(turns.lines(audit, _NEW))
        return (conv, *_result(turns.counts(), int(before(symbols, END)[_NEW]), audit,
                               hashlib.sha256(text.encode()).hexdigest(), text if texts else None), *[None] * 4)

    names = ["conv", *_columns(RESULT), *_columns(_PART)]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=names)
        numbers = [c.split(" ")[0] for c in f"{RESULT}, {_PART}".split(", ") if c.endswith(" long")]
        return f.astype({c: "Int64" for c in numbers})

    for f in frames:
        for new, turn, row, kind, role, text in zip(f["conv"], f["turn"], f["row"], f["kind"], f["role"], f["text"]):
            if new != conv:
                if conv is not None:
                    out.append(done() if whole else part())
                    at, whole = at + 1, True  # the first one may have begun in the range before
                conv, turns = new, Turns()
            if kind == 0:
                mark = row
            elif kind == 1:
                turns.add(None if turn == B.NO_ID else turn, role, text, row != mark)
                if turns.size >= chunk:
                    out.append(part())
                    at, whole, turns = at + 1, False, Turns()
        yield frame(out)
        out = []
    if conv is not None:
        out.append(part())
    yield frame(out)


def _chain(rows: DataFrame, order: Column, schema: str, step) -> DataFrame:
    """Rows of each conversation one after the other, with what ``step(state, row)`` carries: (state, output)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                state, result = step(state if row.conv == conv else None, row)
                conv = row.conv
                out.append((row.conv, row.at, *result))
            yield pd.DataFrame(out, columns=["conv", "at", *_columns(schema)])

    tasks = task_count(rows.sparkSession)
    return rows.repartition(tasks, "conv").sortWithinPartitions("conv", order).mapInPandas(
        run, f"conv string, at long, {schema}")


def _long_ones(parts: DataFrame, texts: bool) -> DataFrame:
    """Results of conversations that come in parts."""
    def costs(state, row):
        right = END if state is None else state
        return _times(np.array(row.matrix, np.int64).reshape(4, 4), right), (right.tolist(), state is None)

    right = _chain(parts.select("conv", "at", "matrix"), F.col("at").desc(), "behind array<long>, last boolean", costs)
    right = cut_lineage(right, "costs")

    def ways(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            exits = [[unrolled(s, entry, np.array(b, np.int64), False)[1] for entry in range(4)]
                     for s, b in zip(f["symbols"], f["behind"])]
            yield f[["conv", "at"]].assign(exits=exits)

    exits = parts.select("conv", "at", "symbols").join(right, ["conv", "at"]).mapInPandas(
        ways, "conv string, at long, exits array<int>")

    def entries(state, row):
        entry = _NEW if state is None else state
        return int(row.exits[entry]), (entry,)

    entry = cut_lineage(_chain(exits, F.col("at"), "entry int", entries), "entries")

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                turns, behind = Turns.unpacked(r.turns), np.array(r.behind, np.int64)
                audit, _ = unrolled(bytes(r.symbols), r.entry, behind, r.last)
                lines = "\n".join(turns.lines(audit, r.entry))
                out.append((r.conv, r.at, pickle.dumps((turns.counts(), audit)), int(before(r.symbols, behind)[r.entry]),
                            lines if any(x != "D" for x in audit) else None))
            yield pd.DataFrame(out, columns=["conv", "at", "found", "cost", "lines"])

    found = parts.select("conv", "at", "symbols", "turns").join(right, ["conv", "at"]).join(entry, ["conv", "at"]).mapInPandas(
        pieces, "conv string, at long, found binary, cost long, lines string")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, counts, cost, audit, digest, kept, some = None, None, 0, [], None, [], False

        def result() -> tuple:
            return (conv, *_result(counts, cost, "".join(audit), digest.hexdigest(), "\n".join(kept) if texts else None))

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.conv != conv:
                    if conv is not None:
                        out.append(result())
                    conv, counts, cost, audit, digest, kept, some = r.conv, None, r.cost, [], hashlib.sha256(), [], False
                more, letters = pickle.loads(bytes(r.found))
                counts = added(counts, more)
                audit.append(letters)
                if r.lines is not None:
                    digest.update((("\n" if some else "") + r.lines).encode())
                    some = True
                    if texts:
                        kept.append(r.lines)
            yield pd.DataFrame(out, columns=["conv", *_columns(RESULT)])
        if conv is not None:
            yield pd.DataFrame([result()], columns=["conv", *_columns(RESULT)])

    return found.repartition(task_count(parts.sparkSession), "conv").sortWithinPartitions("conv", "at").mapInPandas(
        whole, f"conv string, {RESULT}")


def repair(rows: DataFrame, texts: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Cheapest edits that give each conversation the roles ``(s?(ua)+)?`` (initials).

    ``rows`` has conv_id, turn (integer), role, text and dropped (true: the row only names its conversation). Turns
    are taken by ``turn``, nulls first, those of one turn by a digest of role and text. A turn's fault is the first
    of: blank (nothing but ASCII white space), duplicate (role and text came earlier in the conversation), truncated
    (the last character that is no white space is none of ``.!?``). Keep costs 0, Rerole (to user or assistant) 1,
    Delete 2, Insert (an empty user or assistant turn) 5; blank and duplicate turns must go, truncated ones that stay
    cost 5 more. Returns per conversation: conv_id, gaps (turn numbers that are missing between the least and the
    greatest), blank, duplicate, truncated, illegal (neighbours whose initials are not su, ua or au), cost, audit (the
    initials of the edits in order; of the cheapest ones the least in ASCII), repaired_sha256 (of the repaired turns
    ``role:text``, joined by newlines), and repaired, that text, with ``texts`` (else null).

    A null conversation is one like any other; a null role or text is one space, which is a role that cannot stay and
    a blank text. An empty role, or one with another initial, cannot stay either. Repeated rows are duplicates. A
    conversation without turns needs no edit: zeros, an empty audit, the digest of an empty text. Other columns are
    ignored. No rows: no rows.
    """
    B.bounded_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    named = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        B.numbered("turn").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), "dropped")
    read = cut_lineage(_in_order(named).mapInPandas(
        lambda frames: _read(frames, chunk, texts), f"conv string, {RESULT}, {_PART}"), "read")
    parts = read.filter(F.col("at").isNotNull()).select("conv", *_columns(_PART))
    found = read.filter(F.col("at").isNull()).select("conv", *_columns(RESULT)).union(_long_ones(parts, texts))
    return found.select(F.when(F.col("conv") != "", F.expr("substr(conv, 2)")).cast(kind).alias("conv_id"),
                        *_columns(RESULT))
