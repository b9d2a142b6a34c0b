"""Quality of a text by compression: which of two dictionaries shortens it more.

zstandard dictionaries are built from texts labelled good and bad. A text is compressed block by block
with either; the difference of the two sizes over their sum is its feature. Text that repeats itself
shortens with any dictionary, which the difference does not show; so a share of bytes left that is below
what nearly all good texts reach counts too. A logistic curve, fitted on labelled rows that no
dictionary saw, makes both the probability of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import blocks as B

#: The labelled sample: rows per label for the dictionaries and for the curve, and the longest row.
DICTIONARY_ROWS, CURVE_ROWS, ROW_BYTES = 400, 1200, 65_536
DICTIONARY_BYTES = 32_768
#: Bytes compressed on their own, so that the dictionary counts in all parts of a long text.
BLOCK = 2048
LEVEL = 3
#: Part of the good rows that may fall below the share of bytes left from which on it does not count.
REPETITIVE = 0.1


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where there is too little to train on."""
    parts = [t[i:i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


class Model:
    """Two dictionaries and the curve; without both labels the score is the share of label 1."""

    def __init__(self, good: bytes, bad: bytes, base: float = 0.0) -> None:
        self.good, self.bad, self.floor, self.curve = good, bad, 0.0, (0.0, 0.0, base)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tools"}

    def features(self, text: str | None) -> tuple[float, float]:
        """(bytes with the bad dictionary - with the good one) / their sum, over all blocks, and the
        smaller share of bytes left. An empty text has no difference and repeats nothing."""
        if not text or not self.good or not self.bad:
            return 0.0, 1.0
        if not hasattr(self, "tools"):
            self.tools = []
            for d in (self.good, self.bad):
                own = zstandard.ZstdCompressionDict(d)
                own.precompute_compress(level=LEVEL)
                self.tools.append(zstandard.ZstdCompressor(
                    dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        data = text.encode()
        sizes = [sum(len(c.compress(data[i:i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in self.tools]
        return (sizes[1] - sizes[0]) / (sizes[0] + sizes[1]), min(sizes) / len(data)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], float).reshape(-1, 2)
        slope, weight, base = self.curve
        logit = slope * x[:, 0] + weight * np.minimum(x[:, 1], self.floor) + base
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's steps, slightly damped: a weight per feature, and the base."""
    scale = np.abs(x).max(axis=0)
    scale[scale == 0] = 1.0
    rows, damp = np.column_stack([x / scale, np.ones(len(x))]), np.diag([*[1e-2] * x.shape[1], 1e-6])
    at = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ at, -30, 30)))
        slope = rows.T @ (weight * (y - p)) - damp @ at
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + damp, slope)
        at = at + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return (*(at[:-1] / scale).tolist(), float(at[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
        label: str = "quality") -> Model:
    """The model of a bounded sample of the rows of ``docs`` with a label 0 or 1 in ``labels``.

    Rows are taken by the order of a hash of their id; rows longer than ``ROW_BYTES`` teach nothing.
    A row with several labels counts once for each; null labels and ids are left out. The curve is
    weighted to the shares of the labels among all rows.
    """
    marked = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    marked = marked.filter("id is not null and y in (0, 1)").withColumn("h", F.xxhash64("id", F.lit(4)))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(b"", b"")
    want = DICTIONARY_ROWS + CURVE_ROWS
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, min(1.0, 2.0 * want / n)).otherwise(share)
    # at most about twice the rows wanted, whatever the tables hold
    taken = cut_lineage(marked.filter(F.col("h") / F.lit(2.0 ** 64) + 0.5 <= share).distinct(), "labelled")
    rows = (
        docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        .filter(F.octet_length("text").between(1, ROW_BYTES))
        .join(F.broadcast(taken), "id").select("y", "h", "text").distinct()
        .withColumn("rank", F.row_number().over(_by_label())).filter(F.col("rank") <= want)
        .orderBy("y", "rank").collect())
    own = {y: [r["text"] for r in rows if r["y"] == y] for y in (0, 1)}
    total = sum(sizes.values())
    if not own[0] or not own[1]:
        p = min(max(sizes.get(1, 0) / total, 1e-3), 1 - 1e-3)
        return Model(b"", b"", math.log(p / (1 - p)))
    # with few rows a third of them still goes to the curve
    cut = {y: min(DICTIONARY_ROWS, max(1, len(t) * 2 // 3)) for y, t in own.items()}
    model = Model(*(_dictionary([t.encode() for t in own[y][:cut[y]]]) for y in (1, 0)))
    x, y, w = [], [], []
    for mark, texts in own.items():
        held = texts[cut[mark]:] or texts
        x += [model.features(t) for t in held]
        y += [mark] * len(held)
        w += [sizes[mark] / total / len(held)] * len(held)
    weight = np.array(w) * len(w)
    features, marks = np.array(x, float), np.array(y, float)
    model.floor = float(np.quantile(features[marks == 1, 1], REPETITIVE))
    model.curve = _curve(np.column_stack([features[:, 0], np.minimum(features[:, 1], model.floor)]), marks, weight)
    return model


def _by_label():
    from pyspark.sql import Window
    return Window.partitionBy("y").orderBy("h", "text")


def score(docs: DataFrame, model: Model, keep: list[str | Column], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with its score, 0 to 1: higher, label 1 likelier.

    The whole text counts, and nothing else. A null or empty text has the difference 0. Repeated rows
    give repeated rows; names of other columns do not matter.
    """
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema] + ["score double"])
    B.bounded_batches(docs.sparkSession)
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            score = model.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())],
                                             [*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(judge, out)
