"""Repeated passages of words by level-wise doubling.

Level 0 looks at all windows of half the width. A window of the width can only be repeated if both of its
halves are, so level 1 looks at those alone, and decides what is removed. Windows that are repeated at one
length alone are extended to twice that length, level after level, until no candidates survive anywhere: the
last length at which a window of a document is repeated is its ``longest``.

Windows have 64-bit keys, that of a doubled window made of the keys of its halves. Blocks of documents send
their distinct keys to buckets (see ``blocks``), and a bucket answers a bit or two per key. Level 0 only finds
candidates, so its keys are cut to what tells most windows of the corpus apart; level 1 and above compare whole
keys, with more bits of a second key if the corpus is large (``check_type``).
"""

from __future__ import annotations

import math
import pickle
import re

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import blocks as B

#: Bytes of a text that are cut to words at a time.
SLICE = 1 << 20

_NULL_ID = np.iinfo(np.int64).max
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def slices(text: bytes, size: int = SLICE):
    """The words of a text, some at a time; a word is never cut."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end].split()
        at = end


def word_hashes(text: bytes) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    parts = [np.fromiter(map(digest, words), np.uint64, len(words)) for words in slices(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def joined(keys: np.ndarray, step: int) -> np.ndarray:
    """Keys of windows and of those ``step`` words on, as keys of what both cover (as many as there are)."""
    x = keys[:len(keys) - step] * _M1
    x += keys[step:]
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def window_keys(hashes: np.ndarray, width: int) -> np.ndarray:
    """Keys of all windows of ``width`` words."""
    keys, size = hashes, 1
    while size < width:
        step = min(size, width - size)
        keys, size = joined(keys, step), size + step
    return keys


def check_type(size: int):
    """Type of the second key, or None: so wide that one false match in the whole corpus has odds below 1 in 256."""
    need = 2 * math.log2(max(size / 2, 2)) - 1 + 8 - 64
    return next((t for bits, t in ((0, None), (8, np.uint8), (16, np.uint16), (32, np.uint32)) if need <= bits), np.uint64)


def _groups(keys: np.ndarray, check: np.ndarray | None, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys (ties by the last of ``ties`` first), and in it whether a place begins a new key."""
    order = np.lexsort((*ties, *([] if check is None else [check]), keys)) if ties or check is not None \
        else np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    k = keys[order]
    new[1:] = k[1:] != k[:-1]
    if check is not None:
        c = check[order]
        new[1:] |= c[1:] != c[:-1]
    return order, new


class Texts:
    """A block's texts in the order of their ids, as one row of words."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.lengths, self.ends = ids, lengths, np.cumsum(lengths)
        self.n = int(lengths.sum())
        # words from here to the end of the text
        self.left = np.repeat(self.ends, lengths) - np.arange(self.n)
        self.repeated_ids = len(np.unique(ids)) < len(ids)

    def number(self, places: np.ndarray) -> np.ndarray:
        """Which text a word belongs to."""
        return np.searchsorted(self.ends, places, side="right")

    def start(self, places: np.ndarray) -> np.ndarray:
        """Words of the text before each place."""
        return self.lengths[self.number(places)] - self.left[places]

    def windows(self, width: int) -> np.ndarray:
        return np.flatnonzero(self.left >= width)


class Level:
    """Candidates of one length in a block: their places, and the distinct keys that buckets hear of."""

    def __init__(self, texts: Texts, places: np.ndarray, keys: np.ndarray, check: np.ndarray | None) -> None:
        self.texts, self.places = texts, places
        ties = (texts.start(places), texts.ids[texts.number(places)]) if texts.repeated_ids else ()
        order, new = _groups(keys, check, *ties)
        first = np.flatnonzero(new)
        self.entry = np.empty(len(order), np.int64)  # of each place
        self.entry[order] = np.cumsum(new) - 1
        self.keys = keys[order[first]]
        self.check = None if check is None else check[order[first]]
        self.low = places[order[first]]  # the least place of each key
        self.several = np.diff(first, append=len(order)) > 1

    def least(self) -> np.ndarray:
        """Whether a place is the least one of its key, of all in the block (in rows of one id, several are)."""
        if not self.texts.repeated_ids:
            return self.low[self.entry] == self.places
        ids, low = self.texts.ids[self.texts.number(self.places)], self.low[self.entry]
        return (ids == self.texts.ids[self.texts.number(low)]) & (self.texts.start(low) == self.texts.start(self.places))

    def sends(self, name: str, buckets: int, places: bool) -> pd.DataFrame:
        values = [self.several.astype(np.uint8)]
        values += [] if self.check is None else [self.check]
        if places:
            values += [self.texts.ids[self.texts.number(self.low)], self.texts.start(self.low).astype(np.uint32)]
        return B.sends(name, self.keys, values, buckets)

    def flags(self, rows: pd.DataFrame, buckets: int, many: int) -> list[np.ndarray]:
        """The ``many`` bits that the buckets answered for each distinct key."""
        counts = np.diff(B.split(self.keys, buckets))
        rows = rows.sort_values("bucket")
        parts = [[np.unpackbits(a)[:counts[b]] for a in B.unpack(p)] for b, p in zip(rows["bucket"], rows["payload"])]
        return [np.concatenate([p[i] for p in parts]).astype(bool) for i in range(many)]


def _merge(keys: np.ndarray, several: np.ndarray, check: np.ndarray | None = None):
    """A bucket's answer: is the key known from elsewhere too?"""
    order, new = _groups(keys, check)
    begin = np.flatnonzero(new)
    repeated = np.zeros(len(keys), bool)
    if len(keys):
        many = np.diff(begin, append=len(keys)) > 1
        many |= np.logical_or.reduceat(several[order].astype(bool), begin)
        repeated[order] = many[np.cumsum(new) - 1]
    return [repeated], []


def _merge_places(keys, several, *rest):
    """The same, and: does the entry hold the first of all places of the key?"""
    *check, ids, starts = rest
    check = check[0] if check else None
    order, new = _groups(keys, check, starts, ids)
    first = np.zeros(len(keys), bool)
    if len(keys):
        low = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        first[order] = (ids[order] == ids[low]) & (starts[order] == starts[low])
    return [*_merge(keys, several, check)[0], first], []


def _bits(answer: list[np.ndarray]) -> list[np.ndarray]:
    return [np.packbits(a) for a in answer]


class Block:
    """Files of a block: its texts, the keys of its candidates of the width, and what each level found."""

    def __init__(self, name: str, width: int, check: type | None) -> None:
        self.name, self.width, self.check = name, width, check

    def save_texts(self, ids: np.ndarray, texts: list[bytes]) -> None:
        data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        B.put(f"{self.name}.texts", pickle.dumps((ids, [len(t) for t in texts], data)))

    def load_texts(self) -> tuple[np.ndarray, list[bytes]]:
        ids, lengths, data = pickle.loads(B.get(f"{self.name}.texts"))
        whole, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum([0, *lengths])
        return ids, [whole[a:b] for a, b in zip(ends, ends[1:])]

    def first_level(self, ids: np.ndarray, texts: list[bytes], bits: int) -> tuple[Texts, np.ndarray, Level]:
        """Half the width: texts, word hashes, and candidates whose keys are cut to ``bits``."""
        hashes = [word_hashes(t) for t in texts]
        rows = Texts(ids, np.array([len(h) for h in hashes], np.int64))
        hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        half = self.width // 2
        places = rows.windows(half)
        keys = window_keys(hashes, half)[places] if len(places) else np.empty(0, np.uint64)
        low = np.uint64(64 - bits)
        return rows, hashes, Level(rows, places, keys >> low << low, None)

    def save_keys(self, texts: Texts, places: np.ndarray, keys: np.ndarray, second: np.ndarray | None) -> None:
        gaps = np.diff(places, prepend=0)
        lists = [B.smallest(gaps.astype(np.uint64)), keys, *([] if second is None else [second])]
        B.put(f"{self.name}.keys", pickle.dumps((texts.ids, texts.lengths, B.pack(*lists))))

    def load_keys(self) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray | None]:
        """Texts, places of the candidates of the width, and keys by word (0 where there is no candidate)."""
        ids, lengths, data = pickle.loads(B.get(f"{self.name}.keys"))
        gaps, keys, *second = B.unpack(data)
        texts, places = Texts(ids, lengths), np.cumsum(gaps.astype(np.int64))

        def by_word(values: np.ndarray) -> np.ndarray:
            out = np.zeros(texts.n, np.uint64)
            out[places] = values
            return out

        return texts, places, by_word(keys), by_word(second[0]) if second else None

    def save_found(self, length: int, repeated: np.ndarray, longest: np.ndarray, removed: np.ndarray) -> None:
        data = zstandard.ZstdCompressor(level=1).compress(
            pickle.dumps((np.packbits(repeated), longest, np.packbits(removed))))
        B.put(f"{self.name}.found-{length}", data)

    def load_found(self, length: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word begins a repeated window, the longest window so far by text, and words to remove."""
        repeated, longest, removed = pickle.loads(
            zstandard.ZstdDecompressor().decompress(B.get(f"{self.name}.found-{length}")))
        return np.unpackbits(repeated)[:words].astype(bool), longest, np.unpackbits(removed)[:words].astype(bool)


def _both(repeated: np.ndarray, step: int, left: np.ndarray) -> np.ndarray:
    """Places where a repeated window begins and another one ``step`` words on, inside one text."""
    return np.flatnonzero(repeated[:-step] & repeated[step:] & (left[:-step] >= 2 * step)) if len(repeated) > step \
        else np.empty(0, np.int64)


RESULT = "doc_id long, n_words long, starts array<int>, ends array<int>, longest long, kept binary"


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """What each text repeats of passages that start earlier.

    Words are runs of other characters than ASCII white space, compared as they are. A word is removed if a
    window of ``width`` words (an even number) covers it whose words also start earlier: in a text with a
    smaller id, or before it in the same text. Windows are judged on the whole input. Returns per row:
    doc_id, n_words, starts and ends of the maximal removed runs of words, longest (the greatest of width,
    2 * width, 4 * width ... at which a window of the text occurs more than once in the corpus, else 0), and
    kept (the remaining words joined by one space, UTF-8).

    A null or empty text, and one of fewer words than ``width``, loses nothing. A null id counts as the
    largest. Rows that share an id are one document whose texts are laid over each other: of windows at the
    same place of it, none is earlier. Other columns are ignored. No rows: no rows.
    """
    if width < 2 or width % 2:
        raise ValueError("width: an even number of words")
    spark = docs.sparkSession
    B.bounded_batches(spark)
    docs = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NULL_ID)).alias("id"),
                       F.col(text).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = B.bucket_count(docs)
    bits = min(64, 8 * math.ceil((math.log2(max(size, 2)) + 1) / 8))
    check = check_type(size)
    home = B.folder(spark, "passages")

    def second(hashes: np.ndarray) -> np.ndarray | None:
        return None if check is None else hashes * _M3 + np.uint64(1)

    def cut(values: np.ndarray | None) -> np.ndarray | None:
        return None if values is None else (values >> np.uint64(64 - 8 * np.dtype(check).itemsize)).astype(check)

    def half_width(frames):
        for name, ids, texts in B.batches(frames, home):
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            ids, texts = np.array(ids, np.int64)[order], [texts[i] for i in order]
            block = Block(name, width, check)
            block.save_texts(ids, texts)
            yield block.first_level(ids, texts, bits)[2].sends(name, buckets, False)

    def whole_width(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["block"].iloc[0]
        block = Block(name, width, check)
        texts, hashes, level = block.first_level(*block.load_texts(), bits)
        half = width // 2
        repeated = np.zeros(texts.n, bool)
        repeated[level.places] = level.flags(rows, buckets, 1)[0][level.entry]
        del level
        places = _both(repeated, half, texts.left)
        if not len(places):
            return pd.DataFrame(columns=["bucket", "block", "payload"])
        keys = joined(window_keys(hashes, half), half)[places]
        more = None if check is None else joined(window_keys(second(hashes), half), half)[places]
        block.save_keys(texts, places, keys, more)
        return Level(texts, places, keys, cut(more)).sends(name, buckets, True)

    def doubled(length: int):
        """From what the buckets said of ``length`` words: what is repeated, and candidates of twice the length."""
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            name = rows["block"].iloc[0]
            block = Block(name, width, check)
            texts, places, keys, more = block.load_keys()
            size, longest, removed = width, np.zeros(len(texts.ids), np.int64), np.zeros(texts.n, bool)
            while size < length:
                keys, more, size = joined(keys, size), None if more is None else joined(more, size), 2 * size
            if length > width:
                before, longest, removed = block.load_found(length // 2, texts.n)
                places = _both(before, length // 2, texts.left)
            level = Level(texts, places, keys[places], None if more is None else cut(more[places]))
            said = level.flags(rows, buckets, 2 if length == width else 1)
            repeated = np.zeros(texts.n, bool)
            repeated[places] = said[0][level.entry]
            if length == width:
                late = places[~(said[1][level.entry] & level.least())]
                change = np.bincount(late, minlength=texts.n + width) - np.bincount(late + width, minlength=texts.n + width)
                removed = np.cumsum(change)[:texts.n] > 0
            longest[np.unique(texts.number(np.flatnonzero(repeated)))] = length
            block.save_found(length, repeated, longest, removed)
            places = _both(repeated, length, texts.left)
            if not len(places):
                return pd.DataFrame(columns=["bucket", "block", "payload"])
            keys = joined(keys, length)[places]
            more = None if more is None else cut(joined(more, length)[places])
            return Level(texts, places, keys, more).sends(name, buckets, False)

        return run

    def last_pass(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["block"].iloc[0]
        block = Block(name, width, check)
        ids, texts = block.load_texts()
        top, out, at = int(rows["length"].max()), [], 0
        removed, longest = np.empty(0, bool), np.zeros(len(ids), np.int64)
        if top:
            words = sum(len(w) for t in texts for w in slices(t))
            removed = block.load_found(width, words)[2]
            longest = block.load_found(top, words)[1]
        for key, text, most in zip(ids, texts, longest):
            parts, own, begin = [], [], at
            for words in slices(text):
                gone = removed[at:at + len(words)] if top else np.zeros(len(words), bool)
                at += len(words)
                own.append(gone)
                if gone.any():
                    words = [w for w, g in zip(words, gone) if not g]
                if words:
                    parts.append(b" ".join(words))
            gone = np.concatenate(own) if own else np.empty(0, bool)
            edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            out.append((None if key == _NULL_ID else int(key), at - begin, edges[::2].tolist(), edges[1::2].tolist(),
                        int(most), b" ".join(parts)))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "starts", "ends", "longest", "kept"]).astype(
            {"doc_id": "Int64"})

    answers = cut_lineage(B.exchange(docs.mapInPandas(half_width, B.SENT), _merge, _bits), "half")
    known = [answers.select("block", F.lit(0).alias("length"))]
    sent, merge, length = B.by_block(answers).applyInPandas(whole_width, B.SENT), _merge_places, width
    while True:
        answers = cut_lineage(B.exchange(sent, merge, _bits), f"passages{length}")
        if answers.isEmpty():
            break
        known.append(answers.select("block", F.lit(length).alias("length")))
        sent, merge = B.by_block(answers).applyInPandas(doubled(length), B.SENT), _merge
        length *= 2
    reached = known[0]
    for more in known[1:]:
        reached = reached.union(more)
    return B.by_block(reached).applyInPandas(last_pass, RESULT)
