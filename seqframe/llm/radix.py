"""Repeated windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``width`` bytes, by most-significant-digit passes; a group that
stays equal through the last pass is exactly one repeated window.

Digit 1 is a gram of about half the width. Of the suffixes inside a window only the one with the
least gram hash (the *anchor* of the window) takes part in this pass: equal windows have equal
anchors, so nothing is lost and a fifteenth of the suffixes is left. Consecutive windows with one
anchor form a *run*. Groups of one document end here.

Digit 2 is the rest of the run. Equal runs of two documents repeat all their windows.

Digit 3 is the window itself, only for anchors whose runs differ, and only in the document that
holds a run first: at the borders of repeated passages.

Digits are compared by 64-bit hashes below the group of the digit before, 128 bits in all.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import blocks as B

#: Bytes hashed at a time.
CHUNK = 1 << 18

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_R = 0xD6E8FEB86659FD93
_LETTERS = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NULL_ID = np.iinfo(np.int64).max

RESULT = "doc_id long, n_bytes long, starts array<int>, ends array<int>, kept binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


class _Powers:
    """Powers of the base of the prefix hashes and of its inverse, as far as needed."""

    def __init__(self) -> None:
        self.up, self.down = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK + 1)
            for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))


_POWERS = _Powers()


class _Chunk:
    """Some whole texts in one row of bytes, with their windows."""

    def __init__(self, texts: list[bytes], width: int) -> None:
        self.width = width
        self.data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        self.n = len(self.data) - 8
        self.ends = np.cumsum([len(t) for t in texts])
        _POWERS.reach(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_LETTERS[self.data[:self.n]] * _POWERS.up[:self.n], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * _POWERS.down[starts])

    def runs(self) -> tuple[np.ndarray, ...]:
        """Text number, first window, last window and hash of the anchor of each run."""
        empty = np.empty(0, np.int64)
        gram = max(1, self.width // 2 - 1)
        reach = self.width - gram + 1  # grams in a window
        grams = self.n - gram + 1
        if self.n < self.width:
            return empty, empty, empty, empty.astype(np.uint64)
        if gram >= 24:
            eights = _mix(np.ndarray((self.n,), "<u8", self.data, strides=(1,)))
            x = eights[:grams] + eights[8:8 + grams] * _M2 + eights[gram - 8:gram - 8 + grams] * _M3
            x = _mix(x)
        else:
            at = np.arange(grams)
            x = self.hashes(at, at + gram)
        # half of the hash, then the place: the least is the leftmost of equal ones
        low = (x >> np.uint64(32) << np.uint64(32)) | np.arange(grams, dtype=np.uint64)
        size = 1
        while size < reach:
            step = min(size, reach - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        anchor = (low & np.uint64((1 << 32) - 1)).astype(np.int64)  # of each window
        text = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        inside = text[:len(anchor)] == text[self.width - 1:]
        change = np.ones(len(anchor), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        change &= inside
        first = np.flatnonzero(change)
        stop = np.ones(len(anchor), bool)
        stop[:-1] = change[1:] | ~inside[1:]
        stop &= inside
        last = np.flatnonzero(stop)
        # the least hashes of windows crowd at the low end: hashed again, they spread over all buckets
        return text[first], first, last, _mix(x[anchor[first]])


class _Block:
    """The runs of a block's texts, as distinct (anchor, run) entries in order."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], width: int, rest: list[tuple] | None = None) -> None:
        self.ids, self.texts, self.width, self.rest = ids, texts, width, rest or [()] * len(texts)
        self.chunks, found, at, size, base = [], [], 0, 0, 0
        for i, t in enumerate([*texts, None]):
            if t is None or size and size + len(t) > CHUNK:
                c = _Chunk(texts[at:i], width)
                text, first, last, anchor = c.runs()
                content = c.hashes(first, last + width)
                found.append((text + at, first, last, anchor, content, np.full(len(first), len(self.chunks))))
                # only what later passes need of the chunk: its place
                self.chunks.append((at, i))
                at, size = i, 0
            size += len(t or b"")
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 6
        self.text, self.first, self.last, self.anchor, self.content, self.chunk = columns
        self.doc = ids[self.text.astype(np.int64)]
        order = np.lexsort((self.content, self.anchor))
        a, s = self.anchor[order], self.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        self.entry = np.empty(len(order), np.int64)  # of each run
        self.entry[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.keys, self.contents = a[starts].astype(np.uint64), s[starts].astype(np.uint64)
        docs = self.doc[order]
        self.low = np.minimum.reduceat(docs, starts) if len(starts) else docs
        high = np.maximum.reduceat(docs, starts) if len(starts) else docs
        self.several = (self.low != high).astype(np.uint8)

    def save(self, uri: str) -> None:
        data = zstandard.ZstdCompressor(level=3).compress(b"".join(self.texts))
        B.put(uri, pickle.dumps((self.ids, [len(t) for t in self.texts], data, self.rest)))

    @staticmethod
    def load(uri: str, width: int) -> _Block:
        ids, lengths, data, rest = pickle.loads(B.get(uri))
        whole, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum([0, *lengths])
        return _Block(ids, [whole[a:b] for a, b in zip(ends, ends[1:])], width, rest)

    def border_windows(self, dirty: np.ndarray) -> tuple[np.ndarray, ...]:
        """Run and key of each window of the runs numbered ``dirty``."""
        runs, keys = [], []
        for number, (a, b) in enumerate(self.chunks):
            own = dirty[self.chunk[dirty] == number]
            if len(own):
                c = _Chunk(self.texts[a:b], self.width)
                many = self.last[own] - self.first[own] + 1
                run = np.repeat(own, many)
                start = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + self.first[run]
                runs.append((run, start))
                keys.append(_mix(c.hashes(start, start + self.width) + self.anchor[run] * _M3))
        if not runs:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        return (*(np.concatenate(x) for x in zip(*runs)), np.concatenate(keys))


def _merge_runs(keys, contents, low, several):
    """Digit 2. For each entry: 1 if a document of the block repeats a run of an earlier one,
    2 if the block holds the first copy of a run and the anchor has other runs; and the first holders."""
    low = low.astype(np.int64)
    order = np.lexsort((contents, keys))
    a, s, doc = keys[order], contents[order], low[order]
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_s = new_a.copy()
    new_s[1:] |= s[1:] != s[:-1]
    state, holder = np.zeros(len(a), np.uint8), np.zeros(len(a), np.int64)
    if len(a):
        of_a, of_s = np.cumsum(new_a) - 1, np.cumsum(new_s) - 1
        begin_a, begin_s = np.flatnonzero(new_a), np.flatnonzero(new_s)
        first = np.minimum.reduceat(doc, begin_s)[of_s]
        more = several[order].astype(bool)
        repeated = (np.minimum.reduceat(doc, begin_a) != np.maximum.reduceat(doc, begin_a))
        repeated |= np.logical_or.reduceat(more, begin_a)
        unlike = np.add.reduceat(new_s.astype(np.int64), begin_a) > 1
        state[order] = ((doc > first) | more) + 2 * ((doc == first) & (repeated & unlike)[of_a])
        holder[order] = first
    return [state, holder], []


def _merge_windows(keys, low):
    """Digit 3. For each entry: 1 if an earlier document than the block's holds it; and the first holders."""
    low = low.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    k, doc = keys[order], low[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.zeros(len(k), np.int64)
    if len(k):
        first[order] = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    late = (first < low).astype(np.uint8)
    return [late, first], []


def _flagged(answer: list[np.ndarray]) -> list[np.ndarray]:
    """Holders only where the state says something."""
    return [answer[0], answer[1][answer[0] > 0]]


def _joined(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """State and holder of each entry of a block."""
    answers = B.answers_of(rows)
    state = np.concatenate([a[0] for a in answers])
    holder = np.zeros(len(state), np.int64)
    holder[state > 0] = np.concatenate([a[1] for a in answers])
    return state, holder


def _dirty(block: _Block, state: np.ndarray, holder: np.ndarray) -> np.ndarray:
    return np.flatnonzero((state[block.entry] & 2 > 0) & (block.doc == holder[block.entry])
                          ) if len(state) else np.empty(0, np.int64)


def _distinct_windows(block: _Block, dirty: np.ndarray):
    run, start, key = block.border_windows(dirty)
    keys, place = np.unique(key, return_inverse=True)
    low = np.full(len(keys), _NULL_ID, np.int64)
    np.minimum.at(low, place, block.doc[run])
    return run, start, place, keys, low


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                   width: int = 50, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """What each text repeats of documents with smaller ids.

    A byte is removed if a ``width``-byte string that covers it also starts in a document with a
    smaller id. Strings are judged on the whole input, never across documents. Returns per row:
    doc_id, n_bytes, starts and ends of the maximal removed runs, kept (the remaining bytes; with ``as_text``
    a string without the characters that a cut goes through), and the columns ``keep`` as strings.

    A null or empty text, and one shorter than ``width``, removes nothing. A null id counts as the
    largest. Rows with one id do not remove each other. Other columns are ignored. No rows: no rows.
    """
    if not 8 <= width:
        raise ValueError("width: 8 bytes at least")
    spark = docs.sparkSession
    B.bounded_batches(spark)
    keep = keep or []
    docs = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NULL_ID)).alias("id"),
                       *[F.col(c).cast("string").alias(f"keep_{i}") for i, c in enumerate(keep)],
                       F.col(text).cast("string").alias("text"))
    buckets = B.bucket_count(docs)
    home = B.folder(spark, "repeats")

    def first_pass(frames):
        for name, ids, texts in B.batches(frames, home):
            rest = [tuple(None if pd.isna(x) else x for x in i[1:]) for i in ids] if keep else None
            block = _Block(np.array([i[0] for i in ids] if keep else ids, np.int64), texts, width, rest)
            block.save(name)
            yield B.sends(name, block.keys, [block.contents, block.low, block.several], buckets)

    def border_pass(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["block"].iloc[0]
        state, holder = _joined(rows)
        if not (state & 2).any():
            return pd.DataFrame(columns=["bucket", "block", "payload"])
        block = _Block.load(name, width)
        *_, keys, low = _distinct_windows(block, _dirty(block, state, holder))
        return B.sends(name, keys, [low], buckets)

    def last_pass(rows: pd.DataFrame) -> pd.DataFrame:
        name, late = rows["block"].iloc[0], rows["late"].to_numpy(bool)
        state, holder = _joined(rows[~late])
        block = _Block.load(name, width)
        marks: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in block.chunks]
        if len(state):
            copied = np.flatnonzero((state[block.entry] & 1 > 0) & (block.doc > holder[block.entry]))
            for c in range(len(block.chunks)):
                own = copied[block.chunk[copied] == c]
                marks[c].append((block.first[own], block.last[own] + width))
        if late.any():
            run, start, place, keys, low = _distinct_windows(block, _dirty(block, state, holder))
            answers = B.answers_of(rows[late])
            flag = np.concatenate([a[0] for a in answers]) > 0
            low[flag] = np.concatenate([a[1] for a in answers])
            hit = low[place] < block.doc[run]
            for c in range(len(block.chunks)):
                own = hit & (block.chunk[run] == c)
                marks[c].append((start[own], start[own] + width))
        out = []
        for (a, b), found in zip(block.chunks, marks):
            n = sum(len(t) for t in block.texts[a:b])
            change = np.zeros(n + 1, np.int64)
            for x, y in found:
                change += np.bincount(x, minlength=n + 1) - np.bincount(y, minlength=n + 1)
            cover = np.cumsum(change[:n]) > 0
            at = 0
            for i in range(a, b):
                t = block.texts[i]
                own = cover[at:at + len(t)]
                at += len(t)
                edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
                kept = np.frombuffer(t, np.uint8)[~own].tobytes() if len(edges) else t
                kept = kept.decode("utf-8", "ignore") if as_text else kept
                key = block.ids[i]
                out.append((None if key == _NULL_ID else int(key), len(t), edges[::2].tolist(),
                            edges[1::2].tolist(), kept, *block.rest[i]))
        del block, marks
        B.give_back()
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "starts", "ends", "kept", *keep]).astype(
            {"doc_id": "Int64"})

    runs = cut_lineage(B.exchange(docs.mapInPandas(B.lean(first_pass), B.SENT), _merge_runs, _flagged), "runs")
    borders = cut_lineage(
        B.exchange(B.by_block(runs).applyInPandas(border_pass, B.SENT), _merge_windows, _flagged),
        "borders")
    both = runs.withColumn("late", F.lit(False)).unionByName(borders.withColumn("late", F.lit(True)))
    result = RESULT.replace("kept binary", "kept string") if as_text else RESULT
    return B.by_block(both).applyInPandas(last_pass, result + "".join(f", `{c}` string" for c in keep))
