"""Position-specific scoring matrices.

All tables over positions have at most motif length x alphabet rows, positions from 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from .kgrams import windows


def pssm_counts(motifs: DataFrame, motif: str = "motif") -> DataFrame:
    """How often each symbol stands at each position."""
    spots = motifs.select(
        F.upper(motif).alias("_m"),
    ).filter(F.length("_m") > 0).select(
        "_m", F.explode(F.sequence(F.lit(1), F.length("_m"))).alias("_i"))
    return spots.select(
        (F.col("_i") - 1).alias("position"),
        F.substr(F.col("_m"), F.col("_i"), F.lit(1)).alias("symbol"),
    ).groupBy("position", "symbol").agg(F.count(F.lit(1)).alias("n"))


def pssm_information(counts: DataFrame, alphabet: str = K.NUCLEOTIDES) -> DataFrame:
    """Information content 2 + sum(p log2 p) of each position, without pseudocounts."""
    motifs = counts.groupBy("position").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    known = F.col("symbol").isin(*alphabet)
    return counts.join(motifs, "position").groupBy("position").agg(
        (F.lit(2.0) + F.sum(F.when(known, share * F.log2(share)).otherwise(0.0))).alias("information"))


def informative(information: DataFrame, threshold: float = K.INFORMATION_THRESHOLD) -> DataFrame:
    return information.filter(F.col("information") > threshold)


def pssm_logodds(counts: DataFrame, background: dict[str, float] | None = None,
                 pseudocount: float = K.PSEUDOCOUNT) -> DataFrame:
    """ln((n + B p) / (N + B)) - ln(p) for every symbol of the background at every position."""
    background = background or K.BASE_BACKGROUND
    symbols = F.array(*[
        F.struct(F.lit(s).alias("symbol"), F.lit(p).alias("p")) for s, p in background.items()])
    dense = counts.groupBy("position").agg(F.sum("n").alias("total")).select(
        "position", "total", F.inline(symbols))
    n = F.coalesce("n", F.lit(0))
    p, b = F.col("p"), F.lit(float(pseudocount))
    return dense.join(counts, ["position", "symbol"], "left").select(
        "position", "symbol",
        (F.ln((n + b * p) / (F.col("total") + b)) - F.ln(p)).alias("log_odds"))


def _score(weights: dict[int, dict[str, float]], window: Column) -> Column:
    score = F.lit(0.0)
    for position in sorted(weights):
        symbols = "".join(weights[position]) + "."
        cells = [0.0, *weights[position].values(), -math.inf]  # cell 0: any other letter
        table = F.array(*[F.lit(c) for c in cells])
        letter = F.substring(window, position + 1, 1)
        score = score + F.element_at(table, F.instr(F.lit(symbols), letter) + 1)
    return score


def pssm_scan(seqs: DataFrame, keys: list[str], seq: str, logodds: DataFrame, width: int,
              above: float | None = None) -> DataFrame:
    """Score of every window of ``width`` letters; rows (keys, start, score, window).

    The weights (width x alphabet numbers) become part of the expression, so the scan is
    one narrow stage: no join, no shuffle. Other symbols count 0; a window with a gap
    ``.`` at a scored position is rejected.
    """
    weights: dict[int, dict[str, float]] = {}
    for row in logodds.select("position", "symbol", "log_odds").collect():
        weights.setdefault(row[0], {})[row[1]] = row[2]
    found = windows(seqs, [*keys], seq, width).withColumn("score", _score(weights, F.col("window")))
    above = -math.inf if above is None else float(above)
    return found.filter(F.col("score") > F.lit(above)).select(*keys, "start", "score", "window")


def top_windows(scored: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The ``k`` best windows; later starts come first among equal scores."""
    return scored.orderBy(F.desc("score"), F.desc("start"), *keys).limit(k)
