"""Markov models of order k over the symbols of sequences.

A model is a table (context, symbol, n) with at most (alphabet + 1) ** k * alphabet rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as K, count_chars
from ..session import cut_lineage, fits
from .kgrams import grams, overlapping, pieces, split_gram

BROADCAST_ROWS = 200_000
#: Grams of a model that is held as an array.
CELLS = 200_000
ALPHABET = 1000


def markov_train(seqs: DataFrame, seq: str, order: int) -> DataFrame:
    """How often each symbol follows each context."""
    counts = grams(seqs, [], seq, order).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*split_gram(), "n")


def symbol_frequencies(seqs: DataFrame, seq: str, alphabet: str = K.NUCLEOTIDES) -> DataFrame:
    """Share of each symbol of the alphabet over all sequences, and its logarithm."""
    counts = seqs.agg(*[
        F.coalesce(F.sum(count_chars(F.col(seq), s)), F.lit(0)).alias(f"n_{s}") for s in alphabet])
    total = sum((F.col(f"n_{s}") for s in alphabet[1:]), F.col(f"n_{alphabet[0]}"))
    rows = F.array(*[
        F.struct(F.lit(s).alias("symbol"), F.col(f"n_{s}").alias("n"), total.alias("total"))
        for s in alphabet])
    share = F.try_divide(F.col("n"), F.col("total"))
    return counts.select(F.inline(rows)).select(
        "symbol", "n", share.alias("frequency"),
        F.when(share > 0, F.ln(share)).alias("log_p"))


def markov_logq(model: DataFrame) -> DataFrame:
    """Log-probability of each symbol after its context."""
    total = F.sum("n").over(Window.partitionBy("context"))
    return model.withColumn("total", total).withColumn("log_q", F.ln(F.col("n") / F.col("total")))


def model_stats(model: DataFrame) -> DataFrame:
    """Order, training sequences, keys (context totals included) and instances."""
    size = F.length("context") + 1
    contexts = model.groupBy("context").agg(
        F.max(size).alias("size"), F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"))
    return contexts.agg(
        (F.max("size") - 1).cast("int").alias("model_order"),
        F.sum(F.when(F.col("size") == 1, F.col("n")).otherwise(0)).alias("n_sequences"),
        (F.sum("keys") + F.count(F.lit(1))).alias("n_keys"),
        F.sum("n").alias("n_instances"),
    )


def markov_score(seqs: DataFrame, key: str, seq: str, logq: DataFrame, logp: DataFrame, order: int,
                 unseen: float = K.UNSEEN_LOG_Q) -> DataFrame:
    """Sum of log_q - log_p over each sequence.

    A transition that the model never saw has ``unseen`` for log_q; a symbol without
    log_p adds nothing for it. Where an array of all grams is small, pieces of sequences are scored in their row, with
    the model as that array; a larger model is joined, a row per symbol.
    """
    weights, background = _model(logq, logp)
    seqs = seqs.filter(F.col(seq).isNotNull())
    table = _weights(weights, background, order, unseen)
    if table is None:
        return _score_by_join(seqs, key, seq, weights, background, order, unseen)
    scored = pieces(seqs, [key], seq, order, keep_empty=True).withColumn("_w", _score(*table, order))
    return scored.groupBy(key).agg(F.coalesce(F.sum("_w"), F.lit(0.0)).alias("score"))


def markov_score_pieces(parts: DataFrame, key: str, logq: DataFrame, logp: DataFrame, order: int,
                        unseen: float = K.UNSEEN_LOG_Q, size: int = 1 << 16) -> DataFrame:
    """``markov_score`` of sequences that come in pieces: rows (key, offset, piece), as ``read_fasta_pieces`` has them.

    Pieces are dealt over tasks by place, each with the ``order`` letters of the next one, so a sequence of any length
    and any share of the letters is scored by many tasks. A key with only empty pieces scores 0.
    """
    weights, background = _model(logq, logp)
    joined = overlapping(parts, [key], order, size)
    table = _weights(weights, background, order, unseen)
    if table is not None:
        small = pieces(joined.withColumnRenamed("offset", "_at"), [key, "_at"], "piece", order)
        # what begins in the overlap belongs to the next piece
        place = (F.col("_at") + F.col("offset")).alias("offset")
        scored = small.filter(F.col("offset") < size).select(key, place, "piece")
        scored = scored.select(key, _score(*table, order).alias("_w"))
    else:
        found = grams(joined.withColumnRenamed("offset", "_at"), [key, "_at"], "piece", order)
        # the first letters of a later piece are context only, and what begins in the overlap is the next piece's
        own = ((F.col("_at") == 0) | (F.col("position") > order)) & (F.col("position") <= size + order)
        scored = _weighed(found.filter(own), weights, background, unseen).select(key, "_w")
    empty = parts.select(key, F.lit(0.0).alias("_w"))
    return scored.unionByName(empty).groupBy(key).agg(F.sum("_w").alias("score"))


def _model(logq: DataFrame, logp: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Grams with log_q, as a table, and log_p of the symbols."""
    weights = cut_lineage(logq.select(F.concat("context", "symbol").alias("gram"), "log_q"), "log-q")
    background = {r[0]: r[1] or 0.0 for r in logp.select("symbol", "log_p").limit(ALPHABET + 1).collect()}
    if len(background) > ALPHABET:
        raise ValueError(f"an alphabet has at most {ALPHABET} symbols")
    return weights, background


def _weights(weights: DataFrame, background: dict[str, float], order: int,
             unseen: float) -> tuple[str, Column] | None:
    """The symbols, and the weight of each gram of ``order + 1`` digits; None if these are more than ``CELLS``.

    Digit 0 is any other symbol, then come the symbols, and the last digit stands for no symbol before the first.
    """
    if not fits(weights, CELLS):
        return None
    log_q = {r[0]: r[1] for r in weights.collect()}
    symbols = "".join(sorted({c for gram in log_q for c in gram} | set(background)))
    base = len(symbols) + 2
    if base ** (order + 1) > CELLS or len(symbols) > ALPHABET:
        return None
    digit = {c: i + 1 for i, c in enumerate(symbols)}
    last = np.array([0.0, *(background.get(c, 0.0) for c in symbols), 0.0])
    cells = np.tile(unseen - last, base ** order)
    for gram, value in log_q.items():
        if value is not None and 0 < len(gram) <= order + 1:
            code = 0
            for d in [base - 1] * (order + 1 - len(gram)) + [digit[c] for c in gram]:
                code = code * base + d
            cells[code] = value - last[digit[gram[-1]]]
    # constant folding makes one array of the text
    return symbols, F.split(F.lit(",".join(map(repr, cells.tolist()))), ",").cast("array<double>")


def _score(symbols: str, cells: Column, order: int) -> Column:
    """Sum of the weights of a piece's grams: the first piece of a sequence has those of its first letters too.

    The code of a gram is rolled on letter by letter; only letters behind the context count.
    """
    base = len(symbols) + 2
    whole = base ** order
    none = sum((base - 1) * base ** i for i in range(order + 1))
    digit = lambda i: F.instr(F.lit(symbols), F.substr(F.col("piece"), i, F.lit(1)))
    context = F.when(F.col("offset") == 0, F.lit(0)).otherwise(F.lit(order))

    def roll(acc: Column, i: Column) -> Column:
        code = F.pmod(acc["code"], F.lit(whole)) * base + digit(i)
        return F.struct(code.cast("long").alias("code"), (acc["sum"] + F.when(
            i > context, F.element_at(cells, (code + 1).cast("int"))).otherwise(0.0)).alias("sum"))

    start = F.struct(F.lit(none).cast("long").alias("code"), F.lit(0.0).alias("sum"))
    places = F.when(F.length("piece") > 0, F.sequence(F.lit(1), F.length("piece")))
    return F.aggregate(places, start, roll, lambda acc: acc["sum"])


def _weighed(found: DataFrame, weights: DataFrame, background: dict[str, float], unseen: float) -> DataFrame:
    """Rows of grams with their weight; the model travels to them while it is small."""
    if fits(weights, BROADCAST_ROWS):
        weights = F.broadcast(weights)
    table = F.array(F.lit(0.0), *[F.lit(p) for p in background.values()])
    place = F.instr(F.lit("".join(background)), F.right(F.col("gram"), F.lit(1)))
    weight = F.coalesce("log_q", F.lit(unseen)) - F.element_at(table, place + 1)
    return found.join(weights, "gram", "left").withColumn("_w", F.when(F.col("gram").isNull(), 0.0).otherwise(weight))


def _score_by_join(seqs: DataFrame, key: str, seq: str, weights: DataFrame, background: dict[str, float], order: int,
                   unseen: float) -> DataFrame:
    found = grams(seqs, [key], seq, order, keep_empty=True)
    return _weighed(found, weights, background, unseen).groupBy(key).agg(F.sum("_w").alias("score"))


def dump_model(model: DataFrame, order: int) -> DataFrame:
    """Readable lines: each key padded on the left, then the total of each context.

    Rows (sort_key, line); written in the order of sort_key.
    """
    width = order + 1
    keys = model.select(F.concat("context", "symbol").alias("_key"), "n", F.lit("").alias("_dash"))
    sums = model.groupBy("context").agg(F.sum("n").alias("n")).select(
        F.concat("context", F.lit("\u00ff")).alias("_key"), "n",
        F.lit("-" * (width + 13) + " ").alias("_dash"))
    padded = F.lpad("_key", width, "\u0001")
    label = F.when(F.col("_dash") != "", F.col("_dash")).otherwise(
        F.concat(padded, F.lit(" " * 12)))
    return keys.unionByName(sums).select(
        padded.alias("sort_key"), F.concat(label, F.col("n").cast("string")).alias("line"))
