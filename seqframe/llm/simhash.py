"""Near copies by fingerprints, found in a grid of segment counts.

A fingerprint of 64 bits is embedded as the bit counts of its 32 segments of two bits. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints, so fingerprints
within ``reach`` bits lie within ``reach`` in the embedding too. The grid has eight axes, each the
counts of four neighbouring segments. A Manhattan distance of four or less moves at most four axes,
so two such embeddings share their place on four axes at least: they meet in one of the 70 cells
that four axes make. In a cell only fingerprints whose total counts differ by no more than ``reach``
(the bound again, over one segment of 64 bits) are compared, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, task_count
from . import blocks as B
from .components import components

AXES = 8
#: Members of a cell that are compared in one task; larger cells are cut into blocks of that size.
CELL_ROWS = 4096
#: Cells of no more members are compared by shifting whole batches.
SMALL = 16
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> np.ndarray:
    """Hash of each shingle of lower-cased words, repeats included; no words: empty."""
    found = text.encode().lower().split() if isinstance(text, str) else []
    if not found:
        return np.empty(0, np.uint64)
    whole = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, seed)], np.uint64)
    starts = [0, *(ends[:-words] + 1).tolist()]
    view, digest = memoryview(whole), xxhash.xxh64_intdigest
    return np.array([digest(view[a:b], seed) for a, b in zip(starts, ends[words - 1:].tolist())], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                 words: int = 4) -> DataFrame:
    """``doc_id, fp`` of every row: 64 majority bits of its shingle hashes, zero without words."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f.iloc[:, 0], "fp": np.fromiter(
                (_majority(shingle_hashes(t, words)) for t in f.iloc[:, 1]), np.int64, len(f))})

    rows = docs.select(B.numbered(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(B.lean(count), "doc_id long, fp long").withColumn("doc_id", B.renamed("doc_id"))


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, two bits each, as the base-four digits of one number."""
    x = fps.astype(np.uint64)
    return x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))


def cells(fps: np.ndarray, reach: int) -> np.ndarray:
    """Numbers of the cells of each fingerprint, one column per choice of axes."""
    counts = segment_counts(fps)
    masks = [np.uint64(0xFF << 8 * i) for i in range(AXES)]
    columns = []
    for number, axes in enumerate(combinations(range(AXES), AXES - reach)):
        mask = np.uint64(sum(int(masks[i]) for i in axes))
        x = ((counts & mask) + np.uint64(number + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        columns.append(x.view(np.int64))
    return np.stack(columns, axis=1)


def _forest(fps: np.ndarray, reach: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect all that is within reach of each other in one cell: at most one per member."""
    bits = np.bitwise_count(fps)
    order = np.argsort(bits, kind="stable")
    left, weight = fps[order], bits[order].astype(np.int64)
    a, b = [], []
    while len(left):
        queue = [(left[0], weight[0])]
        left, weight = left[1:], weight[1:]
        while queue and len(left):
            x, w = queue.pop()
            lo, hi = np.searchsorted(weight, (w - reach, w + reach + 1))
            near = np.flatnonzero(np.bitwise_count(left[lo:hi] ^ x) <= reach) + lo
            if len(near):
                a.append(np.full(len(near), x))
                b.append(left[near])
                queue += list(zip(left[near], weight[near]))
                keep = np.ones(len(left), bool)
                keep[near] = False
                left, weight = left[keep], weight[keep]
    return a, b


def _compare(frames: Iterator[pd.DataFrame], reach: int) -> Iterator[pd.DataFrame]:
    """Links inside the cells of one sorted partition; memory holds one batch and one cell."""
    def links(key: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        a, b = [], []
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        starts = np.append(np.flatnonzero(new), len(key))
        cell, sizes = np.cumsum(new), np.diff(starts)
        small = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, min(SMALL, len(key))):
            near = np.flatnonzero((cell[d:] == cell[:-d]) & small[d:]
                                  & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= reach))
            a.append(fps[near])
            b.append(fps[near + d])
        for i in np.flatnonzero(sizes > SMALL):
            x, y = _forest(np.unique(fps[starts[i]:starts[i + 1]]), reach)
            a += x
            b += y
        columns = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b)]
        frame = pd.DataFrame(dict(zip("ab", columns)))
        return frame[frame["a"] != frame["b"]]

    rest_key, rest_fps = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
    for f in frames:
        key = np.concatenate([rest_key, f[["cell", "i", "j"]].to_numpy(np.int64)])
        fps = np.concatenate([rest_fps, f["fp"].to_numpy(np.int64).view(np.uint64)])
        if not len(key):
            continue
        last = int(np.argmax((key == key[-1]).all(axis=1)))  # the last cell may go on
        if last:
            yield links(key[:last], fps[:last])
        rest_key, rest_fps = key[last:], fps[last:]
    if len(rest_key):
        yield links(rest_key, rest_fps)


def links(distinct: DataFrame, reach: int = 4) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints (column ``fp``, distinct) within ``reach`` bits.

    Not every close pair is named: a cell with more than a few members gives a spanning forest, so
    thousands of fingerprints close to each other cost no more links than members. A cell of more
    than ``CELL_ROWS`` members is cut into blocks, and each two blocks meet in one task.
    """
    if not 0 <= reach <= 4:
        raise ValueError("reach: 0 to 4 bits")

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fps = f["fp"].to_numpy(np.int64)
            for at in range(0, len(fps), 4096):
                part = fps[at:at + 4096]
                grid = cells(part.view(np.uint64), 4)
                yield pd.DataFrame({"cell": grid.ravel(), "fp": np.repeat(part, grid.shape[1])})

    spark = distinct.sparkSession
    placed = distinct.select("fp").mapInPandas(B.lean(spread), "cell long, fp long")
    heavy = cut_lineage(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
                        .filter(F.col("n") > CELL_ROWS)
                        .select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts")), "heavy")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    met = (
        placed.join(heavy, "cell", "left")
        .withColumn("own", F.when(F.col("parts").isNull(), 0).otherwise(own))
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others)))
        .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    found = (
        met.repartition(task_count(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")
        .mapInPandas(B.lean(lambda frames: _compare(frames, reach)), "a long, b long")
    )
    return found.distinct()


def near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4,
                reach: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``.

    Rows link if their fingerprints differ in at most ``reach`` bits; component_id is the smallest id
    that links reach, the row's own included. Texts without words (null, empty, white space) have the
    fingerprint zero and link like any other. Rows with one text, or one fingerprint, are one class
    before anything is compared. Repeated rows give repeated rows; ids that are null never name a
    component unless all ids of it are null. Other columns are ignored. No rows: no rows.
    """
    B.bounded_batches(docs.sparkSession)
    prints = cut_lineage(fingerprints(docs, id_column, text, words), "fingerprints")
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    joined = components(links(classes, reach))
    rooted = cut_lineage(
        classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
