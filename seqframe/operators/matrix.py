"""Matrices as coordinate tables (i, j, value) and substitution scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(F.col("i"), F.col("j").alias("k"), F.col("value").alias("x"))
    right = b.select(F.col("i").alias("k"), F.col("j"), F.col("value").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(
        F.sum(F.col("x") * F.col("y")).alias("value"))


def matrix_power(matrix: DataFrame, n: int) -> DataFrame:
    """``n``-th power by repeated squaring: about 2 log2(n) products instead of n - 1."""
    if n < 1:
        raise ValueError("the power must be at least 1")
    square, result = matrix.select("i", "j", "value"), None
    while True:
        if n % 2:
            result = square if result is None else cut_lineage(matrix_product(result, square))
        n //= 2
        if not n:
            return result
        square = cut_lineage(matrix_product(square, square))


def substitution_scores(matrix: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Rounded log-odds score of each pair of symbols, the mean of both directions.

    ``matrix`` has rows (i, j, value), ``frequencies`` rows (symbol, frequency).
    """
    odds = matrix.join(frequencies.withColumnRenamed("symbol", "i"), "i").select(
        "i", "j", F.log10(F.col("value") / F.col("frequency")).alias("log_odds"))
    back = odds.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("log_odds").alias("back"))
    return odds.join(back, ["i", "j"]).select(
        F.col("i").alias("a"), F.col("j").alias("b"),
        F.round(10 * (F.col("log_odds") + F.col("back")) / 2).cast("int").alias("score"))
