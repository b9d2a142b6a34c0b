"""Language of a text by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed into phrases, each the
longest match from where the phrase before ended; text that takes few phrases is like the labelled
text. The language with the fewest phrases, normalised by the bits that name a place in its labelled
text, wins.

All pieces of a batch of texts walk through the automata of all languages in step, one letter at a
time, as array look-ups. Texts are read whole; those longer than ``PIECE`` letters are parsed in
pieces of that length, so the work of a batch does not wait for its longest text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import blocks as B

#: The labelled sample: letters of a language's automaton, letters of all automata together, rows
#: taken of a language, and the longest row taken while a language has shorter ones.
LANGUAGE_LETTERS, ALL_LETTERS, SAMPLE_ROWS, ROW_LETTERS = 24_000, 240_000, 128, 8_000
#: Letters with an own code; rarer ones share the other codes.
OWN_CODES, SHARED_CODES = 120, 8
PIECE = 2048
#: Weight of a bit of difference in the score.
SHARPNESS = 0.1
UNKNOWN = "und"

_END = chr(0x10FFFF)
_SPACE, _STOP = 1, 0  # codes; letters follow


def _sample(labelled: DataFrame) -> list[tuple[str, str]]:
    """Up to ``SAMPLE_ROWS`` distinct texts per language, by the order of a hash of the text."""
    known = labelled.filter("text is not null and lang is not null").select("lang", "text")
    known = known.withColumn("long", (F.length("text") > ROW_LETTERS).cast("int"))
    sizes = cut_lineage(known.groupBy("lang", "long").agg(F.count(F.lit(1)).alias("n")), "languages")
    keyed = known.withColumn("h", F.xxhash64("text"))
    # about eight times the rows wanted, then their first ones: copies of a text count as one
    share = F.least(F.lit(1.0), F.lit(8.0 * SAMPLE_ROWS) / F.col("n"))
    some = (
        keyed.join(F.broadcast(sizes), ["lang", "long"])
        .filter((F.col("h") / F.lit(2.0 ** 64) + 0.5) <= share)
        .groupBy("lang", "long", "h").agg(F.first("text").alias("text")))
    rank = F.row_number().over(_by_language())
    rows = some.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_ROWS)
    return [(r["lang"], r["text"]) for r in rows.orderBy("lang", "rank").collect()]


def _by_language():
    from pyspark.sql import Window
    return Window.partitionBy("lang").orderBy("long", "h")


class _Letters:
    """Codes of letters: each frequent letter its own, rarer ones a shared one, all else a space."""

    def __init__(self, frequent: str) -> None:
        self.table = np.full(0x110000, _SPACE, np.uint8)
        rare = [i for i in range(0x110000) if chr(i).isalpha()]
        self.table[rare] = 2 + len(frequent) + np.array(rare) % SHARED_CODES
        for i, c in enumerate(frequent):
            self.table[ord(c)] = 2 + i
        self.table[ord(_END)] = _STOP
        self.size = 2 + len(frequent) + SHARED_CODES

    def codes(self, text: str) -> np.ndarray:
        """Codes with runs of other characters as one space."""
        code = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != _SPACE) | (code[:-1] != _SPACE)
        return code[keep]


def _automaton(codes: np.ndarray, size: int) -> np.ndarray:
    """Transitions of the suffix automaton: row per state, -1 where a letter does not follow."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        now = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and c not in follow[at]:
            follow[at][c] = now
            at = link[at]
        if at >= 0:
            to = follow[at][c]
            if length[to] == length[at] + 1:
                link[now] = to
            else:
                copy = len(follow)
                follow.append(dict(follow[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and follow[at].get(c) == to:
                    follow[at][c] = copy
                    at = link[at]
                link[to] = link[now] = copy
        last = now
    table = np.full((len(follow), size), -1, np.int32)
    for state, edges in enumerate(follow):
        for c, to in edges.items():
            table[state, c] = to
    return table


class Model:
    """Labelled texts by language; automata are built where they are used."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.texts = dict(sorted(texts.items()))
        counts = Counter(c for t in self.texts.values() for c in t.lower() if c.isalpha())
        self.frequent = "".join(sorted(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:OWN_CODES]))

    def build(self) -> Model:
        if not hasattr(self, "table"):
            self.letters = _Letters(self.frequent)
            parts, roots, bits, base = [np.full((1, self.letters.size), -1, np.int32)], [], [], 1  # state 0 follows nothing
            for text in self.texts.values():
                codes = self.letters.codes(text)
                part = _automaton(codes, self.letters.size)
                part[part >= 0] += base
                parts.append(part)
                roots.append(base)
                bits.append(np.log2(len(codes) + 2))
                base += len(part)
            self.table = np.concatenate(parts).ravel()
            self.roots, self.bits = np.array(roots, np.int32), np.array(bits)
        return self

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text for each language, and the number of its codes (0: no letter)."""
        codes = self.letters.codes(_END.join((t or "").replace(_END, " ") for t in texts) + _END)
        stops = np.flatnonzero(codes == _STOP)
        starts = np.concatenate([[0], stops[:-1] + 1])
        sizes = stops - starts
        letters = np.add.reduceat((codes > _SPACE).astype(np.int64), np.minimum(starts, len(codes) - 1))
        pieces = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = starts[text] + number * PIECE
        left = np.minimum(PIECE, sizes[text] - number * PIECE)
        order = np.argsort(-left, kind="stable")
        at, left = at[order], left[order]
        alive = np.searchsorted(-left, -np.arange(1, left[0] + 1), "right") if len(left) else []
        size = self.letters.size
        state = np.zeros((len(self.roots), len(at)), np.int32)
        found = np.zeros((len(self.roots), len(at)), np.int64)
        for step, n in enumerate(alive):
            c = codes[at[:n] + step]
            to = self.table[state[:, :n] * size + c]
            cut = to < 0
            again = self.table[self.roots[:, None] * size + c[None, :]]
            # a letter that the labelled text lacks is a phrase of its own
            state[:, :n] = np.where(cut, np.maximum(again, 0), to)
            found[:, :n] += cut
        total = np.zeros((len(self.roots), len(sizes)), np.int64)
        for row, f in zip(total, found):
            np.add.at(row, text[order], f)
        return total, np.where(letters > 0, sizes, 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.texts or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        phrases, sizes = self.build().phrases(texts)
        cost = phrases * self.bits[:, None]
        best = cost.argmin(axis=0)
        weight = np.exp2(-SHARPNESS * (cost - cost.min(axis=0)))
        names = list(self.texts)
        return ([names[b] if n else UNKNOWN for b, n in zip(best, sizes)],
                np.where(sizes > 0, 1 / weight.sum(axis=0), 0.0))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of a bounded sample of labelled rows; rows without text or language teach nothing."""
    rows = _sample(labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")))
    most = max(1000, min(LANGUAGE_LETTERS, ALL_LETTERS // max(1, len({n for n, _ in rows}))))
    texts: dict[str, str] = {}
    for name, t in rows:
        now = texts.get(name, "")
        if len(now) < most and any(c.isalpha() for c in t):
            texts[name] = f"{now} {t}"[:most]
    return Model(texts)


def predict(docs: DataFrame, model: Model, keep: list[str | Column], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with lang_pred and score.

    score (0 to 1) is the weight of the winner against the other languages. A text that is null or has
    no letter is ``und`` with score 0, and so is every text if nothing was learned. Equal costs: the
    first language in order. Only the text is read for a prediction. Column names other than those of
    the result do not matter; repeated rows give repeated rows.
    """
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    plain = rows.drop("_text")
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema] + ["lang_pred string", "score double"])
    B.bounded_batches(docs.sparkSession)
    texts_by_language = model.texts

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # labelled texts travel, bounded as they are; automata live as long as a task
        model = Model(texts_by_language)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, score = model.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(B.lean(judge), out)
