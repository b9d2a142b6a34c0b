"""Deleted interpolation: word-pair, word and uniform estimates mixed by how often the context was seen.

The probability of a token after its context is ``a * c(context, token) / c(context) + b * c(token) / N
+ (1 - a - b) * base``, with counts over all training texts and ``base`` the smoothed word estimate. The
weights (a, b) belong to the bucket of the context's frequency. They are learned on deleted counts: one
part of the training texts is held out, the estimates for its tokens come from the other parts, and
expectation-maximisation finds the weights under which the held-out counts are likeliest. Then all
training texts count.

Counts of words and word pairs are gathered over the whole corpus by an exchange between blocks (see
``blocks``): each block sends its distinct words and pairs once and is answered with their totals. What
expectation-maximisation needs is a table of bounded size, the held-out tokens by bucket and by the two
ratios of the three estimates.
"""

from __future__ import annotations

import pickle
from itertools import count
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import blocks as B

#: Buckets of context counts: powers of two. Steps of the ratios are a quarter of a power of two.
BUCKETS, STEP, REACH = 24, 4, 30
ROUNDS = 100

_END = b"\n"  # no word holds it
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case, cut at ASCII white space, and one end."""
    return [*text.lower().split(), _END]


class _Block:
    """The texts of a block as numbers of its own distinct words, which are sorted by hash."""

    def __init__(self, ids: list, kinds: np.ndarray, texts: list[bytes]) -> None:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        own = [np.fromiter(map(numbers.__getitem__, tokens_of(t)), np.int32) for t in texts]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in numbers), np.uint64, len(numbers))
        self.words = np.unique(hashes)
        place = np.searchsorted(self.words, hashes).astype(np.int32)
        self.ids, self.kinds, self.sizes = ids, kinds, np.array([len(o) for o in own])
        self.tokens = place[np.concatenate(own)]
        self._pairs()

    def _pairs(self) -> None:
        """Distinct (context, token) of the block and their places; a text begins after an end."""
        self.kind = np.repeat(self.kinds, self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        end = np.searchsorted(self.words, np.uint64(xxhash.xxh64_intdigest(_END)))
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[first] = end
        local = self.context.astype(np.int64) * len(self.words) + self.tokens
        pairs, place = np.unique(local, return_inverse=True)
        a, b = self.words[pairs // len(self.words)], self.words[pairs % len(self.words)]
        x = (a ^ (a >> np.uint64(31))) * _MIX + b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        order = np.argsort(x)
        self.pairs = x[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.pair = rank[place]

    def save(self, uri: str) -> None:
        data = pickle.dumps((self.ids, self.kinds, self.sizes, self.words, B.pack(B.smallest(self.tokens))))
        B.put(uri, zstandard.ZstdCompressor(level=1).compress(data))

    @classmethod
    def load(cls, uri: str) -> _Block:
        own = cls.__new__(cls)
        data = pickle.loads(zstandard.ZstdDecompressor().decompress(B.get(uri)))
        own.ids, own.kinds, own.sizes, own.words, tokens = data
        own.tokens = B.unpack(tokens)[0].astype(np.int32)
        own._pairs()
        return own

    def counted(self, place: np.ndarray, n: int) -> list[np.ndarray]:
        """Occurrences in training texts, and in the held-out part of them."""
        return [np.bincount(place[own], minlength=n).astype(np.uint64) for own in (self.kind > 0, self.kind == 2)]


def _add(keys, *counts):
    """Totals of each entry's key; the bucket's totals for the corpus."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    starts, totals, extra = np.flatnonzero(new), [], []
    for c in counts:
        c = c.astype(np.uint64)
        whole = np.empty(len(c), np.uint64)
        if len(c):
            sums = np.add.reduceat(c[order], starts)
            whole[order] = sums[np.cumsum(new) - 1]
            extra.append(sums)
        totals.append(whole)
    stats = [int(s.sum()) for s in extra] + [int((s > 0).sum()) for s in extra] if extra else [0] * 2 * len(counts)
    return totals, [("", [np.array(stats, np.int64)])]


class _Answered:
    """A block with the corpus totals of its words and pairs."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.block = _Block.load(rows["block"].iloc[0])
        own = {}
        for name, part in rows.groupby("kind"):
            answers = B.answers_of(part)
            own[name] = [np.concatenate([a[i] for a in answers]).astype(np.float64) for i in (0, 1)]
        empty = [np.empty(0)] * 2
        self.word, self.word_held = own.get("word", empty)
        self.pair, self.pair_held = own.get("pair", empty)

    def estimates(self, held: bool, n: int, distinct: int):
        """Pair estimate, word estimate, base and context count of every token.

        ``held``: without the held-out part of the training texts.
        """
        word = self.word - self.word_held if held else self.word
        pair = self.pair - self.pair_held if held else self.pair
        context = word[self.block.context]
        after = np.where(context > 0, pair[self.block.pair] / np.maximum(context, 1), 0.0)
        count = word[self.block.tokens]
        return after, count / max(n, 1), (count + 1) / (n + distinct + 1), context


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _ratio(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Step of log2(x / base), from 1 on; 0 where x is zero."""
    with np.errstate(divide="ignore"):
        step = np.round(STEP * np.log2(x / base))
    return np.where(x > 0, np.clip(step, -STEP * REACH, STEP * REACH) + STEP * REACH + 1, 0).astype(np.int64)


_SIDE = 2 * STEP * REACH + 2


def learn(cells: pd.DataFrame) -> np.ndarray:
    """Weights (pair, word, base) of each bucket by expectation-maximisation over the held-out cells.

    A bucket with no held-out tokens takes the weights of all buckets together.
    """
    def ratios(step: np.ndarray) -> np.ndarray:
        return np.where(step > 0, np.exp2((step - 1 - STEP * REACH) / STEP), 0.0)

    def maximise(own: pd.DataFrame) -> np.ndarray:
        x = np.stack([ratios(own["after"].to_numpy()), ratios(own["single"].to_numpy()), np.ones(len(own))], axis=1)
        n, w = own["n"].to_numpy(float), np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            part = x * w
            w = (n[:, None] * part / part.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
        # no weight of the base may vanish: every text has a probability
        w = np.maximum(w, 1e-6)
        return w / w.sum()

    whole = maximise(cells) if len(cells) else np.array([0.0, 0.5, 0.5])
    out = np.tile(whole, (BUCKETS, 1))
    for bucket, own in cells.groupby("bucket"):
        out[int(bucket)] = maximise(own)
    # without a seen context there is no pair estimate
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


def score(docs: DataFrame, training: Column, held: Column, id_column: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``doc_id, training, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``training`` tells which rows count; ``held`` which of them are the held-out part for the weights.
    Scores are log10 probabilities of the whole text with its end. A null or empty text is its end
    alone. n_known: tokens that training texts hold. Repeated rows count and are scored each. Other
    columns do not matter. Without training rows all counts are zero, and the score is the base score.
    """
    spark = docs.sparkSession
    B.bounded_batches(spark)
    kind = F.when(F.coalesce(training, F.lit(False)), F.when(F.coalesce(held, F.lit(False)), 2).otherwise(1)).otherwise(0)
    docs = docs.select(B.numbered(id_column).alias("id"), kind.alias("kind"),
                       F.col(text).cast("string").alias("text"))
    buckets = B.bucket_count(docs)
    home = B.folder(spark, "interpolation")

    def send(frames):
        for name, keys, texts in B.batches(frames, home):
            block = _Block([None if i == B.NO_ID else int(i) for i, _ in keys],
                           np.array([k for _, k in keys], np.int8), texts)
            block.save(name)
            for kind, keys, place in (("word", block.words, block.tokens), ("pair", block.pairs, block.pair)):
                frame = B.sends(name, keys, block.counted(place, len(keys)), buckets)
                # words and pairs go to buckets of their own
                yield frame.assign(bucket=frame["bucket"] * 2 + (kind == "pair"))

    answers = cut_lineage(B.exchange(docs.mapInPandas(send, B.SENT), _add, lambda x: [B.smallest(t) for t in x]),
                          "totals")
    answers = answers.withColumn("kind", F.when(F.col("bucket") % 2 == 0, "word").otherwise("pair"))
    totals = answers.filter((F.col("block") == "") & (F.col("kind") == "word")).select("payload")

    def read(frames):
        for f in frames:
            yield pd.DataFrame([B.unpack(p)[0].tolist() for p in f["payload"]], columns=["n", "held", "v", "v_held"])

    sums = totals.mapInPandas(read, "n long, held long, v long, v_held long").agg(
        *[F.sum(c).alias(c) for c in ("n", "held", "v", "v_held")]).first()
    n, n_held, distinct = (int(sums[c] or 0) for c in ("n", "held", "v"))
    to_blocks = answers.filter(F.col("block") != "")

    def cells(rows: pd.DataFrame) -> pd.DataFrame:
        own = _Answered(rows)
        pick = own.block.kind == 2
        after, single, base, context = (x[pick] for x in own.estimates(True, n - n_held, distinct))
        code = (_bucket(context) * _SIDE + _ratio(after, base)) * _SIDE + _ratio(single, base)
        code, many = np.unique(code, return_counts=True)
        return pd.DataFrame({"bucket": code // _SIDE // _SIDE, "after": code // _SIDE % _SIDE,
                             "single": code % _SIDE, "n": many})

    # at most BUCKETS * _SIDE ** 2 rows, in truth a few thousand: the ratios hang together
    table = (B.by_block(to_blocks).applyInPandas(cells, "bucket long, after long, single long, n long")
             .groupBy("bucket", "after", "single").agg(F.sum("n").alias("n")).toPandas())
    weights = learn(table)

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        own = _Answered(rows)
        block = own.block
        after, single, base, context = own.estimates(False, n, distinct)
        w = weights[_bucket(context)] if n else np.array([[0.0, 0.0, 1.0]])
        mixed = np.log10(w[:, 0] * after + w[:, 1] * single + w[:, 2] * base)
        starts = np.cumsum(block.sizes) - block.sizes
        known = (own.word[block.tokens] > 0).astype(np.int64)
        return pd.DataFrame({
            "doc_id": pd.array(block.ids, dtype="Int64"), "training": block.kinds > 0, "n_tokens": block.sizes,
            "n_known": np.add.reduceat(known, starts), "train_tokens": n,
            "base_score": np.add.reduceat(np.log10(base), starts), "score": np.add.reduceat(mixed, starts)})

    return B.by_block(to_blocks).applyInPandas(
        judge, "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")
