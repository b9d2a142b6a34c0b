"""Packing of token pieces into sequences by non-negative least squares over their lengths.

Only the histogram of the lengths decides: pieces of one length are alike. Shallow combinations of
lengths that fill a sequence exactly are enumerated, their repeat counts are solved against the
histogram, rounded down, and what is left is packed greedily, the longest first. The plan, at most a few
thousand combinations whatever the corpus, is then dealt to the pieces by their number among those
of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, task_count
from . import blocks as B

#: Words whose ids a worker remembers; rows tokenized at a time.
CACHE_WORDS, ROWS = 800_000, 500
#: Third lengths tried for each length, the most frequent ones; steps of the solver.
THIRDS, STEPS = 24, 120


#: Where a letter meets an ASCII character that is none; no token of the tokenizer spans that place.
_BOUNDARY = re.compile(r"(?<=[^\W\d_])(?=[!-@\[-`{-~])")


def _parts(word: str) -> list[str]:
    """A word cut at its boundaries; not cut if a letter before one turns into something that ends in a mark.

    The tokenizer sees lower case: of a capital I with a dot, the dot becomes a mark of its own and belongs to
    the punctuation behind it.
    """
    parts = _BOUNDARY.split(word)
    if word.isascii() or all(normalize("NFC", p[-1].lower())[-1].isalpha() for p in parts[:-1]):
        return parts
    return [word]


class _Words:
    """Ids of words, remembered. The tokenizer cuts at white space, and behind runs of letters, before it
    merges; so words between blanks, and the letters of a word before its punctuation, are encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _one_by_one(self, words: list[str]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.known[word] = array("I", e.ids).tobytes()

    def _encode(self, words: list[str]) -> None:
        """Words of letters, many in one text: the last id of each is known by its mark."""
        groups = [words[i:i + 64] for i in range(0, len(words), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(ids):  # letters that change as they are normalised
                self._one_by_one(group)
                continue
            data, first = ids.tobytes(), 0
            for word, cut in zip(group, (4 * cuts).tolist()):
                self.known[word] = data[first:cut]
                first = cut

    def learn(self, words: set[str]) -> None:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        fresh = [w for w in words if w not in known]
        # capitals of ASCII words make no difference
        letters = {w: w.lower() if w.isascii() else w for w in fresh if w.isalpha()}
        mixed, odd = {}, []
        for w in fresh:
            if w in letters:
                continue
            parts = _parts(w)
            if len(parts) == 1 or "<|" in w:  # the tokenizer looks for its special tokens, "<|...|>", first
                odd.append(w)
            else:
                mixed[w] = [p.lower() if p.isascii() else p for p in parts]
        new = [p for p in set(letters.values()).union(*mixed.values()) if p not in known]
        plain = [p for p in new if p.isalpha()]
        for at in range(0, len(plain), 64_000):
            self._encode(plain[at:at + 64_000])
        self._one_by_one([*(p for p in new if not p.isalpha()), *odd])
        known.update((w, known[p]) for w, p in letters.items() if w is not p)
        known.update((w, b"".join([known[p] for p in parts])) for w, parts in mixed.items())


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def token_ids(texts: list[str | None], path: str, end_id: int) -> list[bytes]:
    """Little-endian 32-bit ids of each text, with ``end_id`` behind."""
    words = _words(path)
    split = [t.split(" ") if isinstance(t, str) else [] for t in texts]
    words.learn(set().union(*split))
    end = array("I", [end_id]).tobytes()
    return [b"".join(map(words.known.__getitem__, own)) + end for own in split]


def token_pieces(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2,
                 id_column: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens[, ids]``: texts cut into pieces of ``window`` ids."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), ROWS):
                part = f.iloc[at:at + ROWS]
                rows = []
                for key, ids in zip(part.iloc[:, 0], token_ids(list(part.iloc[:, 1]), path, end_id)):
                    for start in range(0, len(ids), 4 * window):
                        piece = ids[start:start + 4 * window]
                        rows.append((int(key), start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4,
                                     *([np.frombuffer(piece, "<i4")] if keep_ids else [])))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
                yield pd.DataFrame(rows, columns=names)
        # workers live on after a task; what it learned need not
        _words(path).known.clear()

    B.bounded_batches(docs.sparkSession)
    rows = docs.select(B.numbered(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(B.lean(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
                            + ", ids array<int>" * keep_ids).withColumn("doc_id", B.renamed("doc_id"))


def _combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Combinations that fill the window: up to three lengths each, and how often each is used."""
    there = set(lengths.tolist())
    found: set[tuple] = set()
    for a in there:
        for k in range(1, window // a + 1):
            b = window - k * a
            if b == 0:
                found.add(((a, k),))
            elif b in there and b != a:
                found.add(tuple(sorted(((a, k), (b, 1)))))
    often = lengths[np.argsort(-counts, kind="stable")][:THIRDS].tolist()
    for a in there:
        for b in often:
            c = window - a - b
            if c in there and len({a, b, c}) == 3:
                found.add(tuple(sorted(((a, 1), (b, 1), (c, 1)))))
    place = {n: i for i, n in enumerate(lengths.tolist())}
    rows = sorted(found)
    which = np.array([[place[n] for n, _ in r] + [0] * (3 - len(r)) for r in rows], np.int64).reshape(-1, 3)
    used = np.array([[k for _, k in r] + [0] * (3 - len(r)) for r in rows], float).reshape(-1, 3)
    return which, used


def _solve(which: np.ndarray, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts x that bring ``sum(used * x)`` near the histogram in least squares.

    Multiplicative steps: they keep x non-negative and never raise the error.
    """
    goal = (used * counts[which]).sum(axis=1)
    x = np.full(len(which), counts.sum() / max(1, used.sum()))
    for _ in range(STEPS):
        made = np.bincount(which.ravel(), (used * x[:, None]).ravel(), len(counts))
        x *= goal / np.maximum((used * made[which]).sum(axis=1), 1e-9)
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences as ``(times, [(length, pieces), ...])`` that use the whole histogram."""
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[n] for n in sizes.tolist()], np.int64)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    if not len(sizes):
        return out
    which, used = _combinations(sizes, left, window)
    if len(which):
        x = _solve(which, used, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            slots = [(int(w), int(u)) for w, u in zip(which[i], used[i]) if u]
            times = min(int(x[i] + 0.25), *(int(left[w]) // u for w, u in slots))
            if times > 0:
                for w, u in slots:
                    left[w] -= times * u
                out.append((times, [(int(sizes[w]), u) for w, u in slots]))
    rest = [(int(n), int(c)) for n, c in zip(sizes, left) if c]
    names, amount = [n for n, _ in rest], dict(rest)
    while names:
        gap, pattern, top = window, {}, len(names)
        while gap and top:
            top = bisect_right(names, gap, 0, top)
            if not top:
                break
            n = names[top - 1]
            pattern[n] = min(gap // n, amount[n])
            gap -= n * pattern[n]
            top -= 1
        times = min(amount[n] // u for n, u in pattern.items())
        out.append((times, sorted(pattern.items(), reverse=True)))
        for n, u in pattern.items():
            amount[n] -= times * u
        names = [n for n in names if amount[n]]
    return out


def pack(pieces: DataFrame, window: int = 4096) -> DataFrame:
    """``pieces`` (unique by doc_id, start, ids_crc32; ``length`` from 1 to ``window``) with sequence_id and offset.

    Sequences hold at most ``window`` ids and have no gaps. Only the histogram, at most ``window`` numbers,
    and the plan reach the driver. Equal pieces (repeated rows) get places of their own.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    deals: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
    taken, sequence = dict.fromkeys(histogram, 0), 0
    for times, slots in plan(histogram, window):
        offset = 0
        for n, used in slots:
            deals[n].append((taken[n], sequence, used, offset))
            taken[n] += times * used
            offset += n * used
        sequence += times
    tables = {n: np.array(d, np.int64).T for n, d in deals.items()}

    # numbers among equals in two levels, so that a length that many pieces share is not one group
    parts = task_count(spark)
    pieces = pieces.withColumn("doc_id", B.numbered("doc_id"))
    rows = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32")
    numbered = (rows.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_part"])
                .withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_part", "_before"))
    held = spark.sparkContext.broadcast(tables)  # bounded by the plan

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(), f["_rank"].to_numpy()
            place, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, sequence, used, begin = held.value[int(n)]
                i = np.searchsorted(first, rank[own], "right") - 1
                number = rank[own] - first[i]
                place[own] = sequence[i] + number // used[i]
                offset[own] = begin[i] + number % used[i] * n
            yield f.drop(columns="_rank").assign(sequence_id=place, offset=offset)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.select(*pieces.columns, "_rank").mapInPandas(
        deal, f"{names}, sequence_id long, offset long").withColumn("doc_id", B.renamed("doc_id"))


def packed(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, id_column: str = "doc_id",
           text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Every text as pieces with their place in a sequence.

    A null or empty text is one piece that holds ``end_id``. Longer texts than a sequence are cut at its
    length. Repeated rows are packed each. Other columns are ignored. No rows: no rows.
    """
    return pack(cut_lineage(token_pieces(docs, path, window, end_id, id_column, text, keep_ids), "pieces"), window)
