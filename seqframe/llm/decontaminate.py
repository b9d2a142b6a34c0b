"""Benchmark passages in documents, by a prefix-filtered join of word windows.

A window is ``width`` consecutive words of an item, or a whole shorter item. The words of a window are
ordered by rarity, counted over all documents; containment must be whole, so the necessary prefix is
one word: the rarest. Documents are joined with the windows on it. The place of the word inside the
window fixes where the window would begin, so windows that would begin before the document or end
behind it are left out (positional and length bound), and the rest is compared word by word.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import blocks as B

#: Bytes of benchmark text in one index. A larger benchmark makes more indexes, each held in turn.
INDEX_BYTES = 4 << 20
#: Rows of documents read at a time.
ROWS = 2000

RESULT = "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean"

_SPACE = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if i in _SPACE else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: digits, letters with A-Z in lower case, and all beyond ASCII."""
    return text.encode().translate(_TABLE).split() if isinstance(text, str) else []


def windows_of(words: list[bytes], width: int) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i:i + width] for i in range(max(1, len(words) - width + 1))]


@lru_cache(maxsize=1)
def _index(uri: str) -> tuple:
    return pickle.loads(B.get(uri))


@lru_cache(maxsize=1)
def _words(uri: str) -> frozenset:
    return pickle.loads(B.get(uri))


def _vocabulary(items: DataFrame, home: str) -> list[str]:
    """One file of distinct words per index."""
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        uri = f"{home}/words-{int(rows['part'].iloc[0]):05d}"
        B.put(uri, pickle.dumps(frozenset(w for t in rows["text"] for w in words_of(t))))
        return pd.DataFrame({"uri": [uri]})

    return sorted(r[0] for r in items.groupBy("part").applyInPandas(write, "uri string").collect())


def _rarity(texts: DataFrame, vocabularies: list[str]) -> DataFrame:
    """``word, n``: how often each benchmark word occurs in all documents."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), ROWS):
                seen = Counter()
                for t in f["text"].iloc[at:at + ROWS]:
                    seen.update(words_of(t))
                wanted = set().union(*(_words(u) & seen.keys() for u in vocabularies))
                yield pd.DataFrame([(w, seen[w]) for w in wanted], columns=["word", "n"])

    counted = texts.mapInPandas(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _build(items: DataFrame, rarity: DataFrame, home: str, width: int) -> list[str]:
    """One file per index: places of the rarest words, and the windows with their items."""
    def write(key: tuple, rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        rare = dict(zip(counts["word"].map(bytes), counts["n"]))
        places, windows = defaultdict(set), defaultdict(set)
        for item, text in zip(rows["item"], rows["text"]):
            for w in windows_of(words_of(text), width):
                offset = min(range(len(w)), key=lambda i: (rare.get(w[i], 0), w[i]))
                places[w[offset]].add((offset, len(w)))
                windows[b" ".join(w)].add(item)
        uri = f"{home}/index-{int(key[0]):05d}"
        B.put(uri, pickle.dumps(({k: sorted(v) for k, v in places.items()},
                                 {k: sorted(v) for k, v in windows.items()})))
        return pd.DataFrame({"uri": [uri]})

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, w) for p, t in zip(f["part"], f["text"]) for w in set(words_of(t))]
            yield pd.DataFrame(rows, columns=["part", "word"])

    words = (items.select("part", "text").mapInPandas(spell, "part int, word binary")
             .distinct().join(rarity, "word"))
    built = items.groupBy("part").cogroup(words.groupBy("part")).applyInPandas(write, "uri string")
    return sorted(r[0] for r in built.collect())


def _hits(words: list[bytes], places: dict, windows: dict, hit: np.ndarray, items: set) -> None:
    """Mark the words inside any window and add the items whose windows occur."""
    rare = places.keys() & set(words)
    if not rare:
        return
    n = len(words)
    for at, word in enumerate(words):
        if word in rare:
            for offset, length in places[word]:
                start = at - offset
                if start >= 0 and start + length <= n:
                    found = windows.get(b" ".join(words[start:start + length]))
                    if found:
                        hit[start:start + length] = True
                        items.update(found)


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
                  item_column: str = "item_id", item_text: str = "text", width: int = 13,
                  per: int = 20) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` of every row of ``docs``.

    n_hit counts the words inside any occurrence of a window; items are the ids (as text, sorted) of
    the items with occurring windows; contaminated: n_hit is positive and at least one in ``per`` words.

    Null or empty texts have no words. Items without words have no windows; a null item id counts as
    the empty id; items with one id are one item. Repeated rows give repeated rows; other columns are
    ignored. An empty benchmark contaminates nothing.
    """
    spark = docs.sparkSession
    B.bounded_batches(spark)
    home = B.folder(spark, "benchmark")
    texts = docs.select(B.numbered(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"),
                             F.col(item_text).cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // INDEX_BYTES)
    if parts:
        items = cut_lineage(
            items.distinct().withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int")), "items")
        rarity = cut_lineage(_rarity(texts.select("text"), _vocabulary(items, home)), "rarity")
        indexes = _build(items, rarity, home, width)
    else:
        indexes = []

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for first in range(0, len(f), ROWS):
                part = f.iloc[first:first + ROWS]
                split = [words_of(t) for t in part["text"]]
                hits = [np.zeros(len(w), bool) for w in split]
                found: list[set] = [set() for _ in split]
                for uri in indexes:
                    places, windows = _index(uri)
                    for w, h, s in zip(split, hits, found):
                        _hits(w, places, windows, h, s)
                n_hit = [int(h.sum()) for h in hits]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "n_words": [len(w) for w in split],
                    "n_hit": n_hit, "items": [sorted(s) for s in found],
                    "contaminated": [h > 0 and per * h >= len(w) for h, w in zip(n_hit, split)]})

    return texts.mapInPandas(judge, RESULT).withColumn("doc_id", B.renamed("doc_id"))
