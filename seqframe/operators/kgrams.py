"""Sliding windows over sequences of any length.

A sequence is first cut into pieces with one linear pass of a regular expression; each
piece also holds the letters that windows starting in it still need. Positions inside a
piece are short, so taking a substring costs little wherever it lies in the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PIECE = 64


def pieces(df: DataFrame, keys: list[str], seq: str, overlap: int, size: int = PIECE,
           keep_empty: bool = False) -> DataFrame:
    """Rows (keys, offset, piece): ``size`` letters plus up to ``overlap`` of the next ones.

    An empty sequence has no piece, or one NULL piece with ``keep_empty``.
    """
    pattern = f"(?s)(?=(.{{1,{size + overlap}}})).{{1,{size}}}"
    return df.select(
        *keys, (F.posexplode_outer if keep_empty else F.posexplode)(
            F.regexp_extract_all(F.col(seq), F.lit(pattern), F.lit(1))).alias("_no", "piece")
    ).select(*keys, (F.col("_no") * size).cast("long").alias("offset"), "piece")


def overlapping(parts: DataFrame, keys: list[str], overlap: int, size: int = 1 << 16) -> DataFrame:
    """Pieces of a sequence that follow each other, as pieces of ``size`` letters plus up to ``overlap`` of the
    next ones: rows (keys, offset, piece).

    ``parts`` has rows (keys, offset, piece) of any length, as ``read_fasta_pieces`` gives them. Windows and grams
    of one piece, moved by its offset, are then those of the whole sequence.
    """
    end = F.col("offset") + F.length("piece")
    first = F.greatest(F.floor((F.col("offset") - overlap) / size), F.lit(0))
    spread = parts.filter(F.length("piece") > 0).withColumn(
        "_no", F.explode(F.sequence(first.cast("long"), F.floor((end - 1) / size).cast("long"))))
    begin = F.greatest(F.col("_no") * size, F.col("offset"))
    stop = F.least((F.col("_no") + 1) * size + overlap, end)
    cutted = spread.withColumns({"_from": begin, "_letters": F.substr(
        "piece", (begin - F.col("offset") + 1).cast("int"), (stop - begin).cast("int"))}).filter(stop > begin)
    joined = cutted.groupBy(*keys, "_no").agg(F.array_sort(F.collect_list(F.struct("_from", "_letters"))).alias("_p"))
    return joined.select(*keys, (F.col("_no") * size).alias("offset"),
                         F.array_join(F.transform("_p", lambda p: p["_letters"]), "").alias("piece"))


def windows_of_pieces(parts: DataFrame, keys: list[str], width: int, size: int = 1 << 16) -> DataFrame:
    """Every window of ``width`` letters of sequences that come in pieces (see ``windows``)."""
    whole = overlapping(parts, keys, width - 1, size).withColumnRenamed("offset", "_at")
    found = windows(whole, [*keys, "_at"], "piece", width)
    # windows that begin in the overlap belong to the next piece
    return found.filter(F.col("start") < size).select(*keys, (F.col("_at") + F.col("start")).alias("start"), "window")


def windows(df: DataFrame, keys: list[str], seq: str, width: int, size: int = PIECE) -> DataFrame:
    """Every window of ``width`` letters: rows (keys, start, window), start counted from 0."""
    cutted = pieces(df, keys, seq, width - 1, size)
    last = F.least(F.lit(size), F.length("piece") - width + 1)
    return (
        cutted.filter(last >= 1)
        .select(*keys, "offset", "piece", F.explode(F.sequence(F.lit(1), last)).alias("_i"))
        .select(*keys, (F.col("offset") + F.col("_i") - 1).alias("start"),
                F.substr(F.col("piece"), F.col("_i"), F.lit(width)).alias("window"))
    )


def grams(df: DataFrame, keys: list[str], seq: str, k: int, size: int = PIECE,
          keep_empty: bool = False) -> DataFrame:
    """Each symbol together with the ``k`` symbols before it, fewer at the start of a sequence.

    Rows (keys, position, gram), position counted from 1; the symbol is the last letter. With
    ``keep_empty`` an empty sequence has one row with a NULL gram.
    """
    cutted = pieces(df, keys, seq, k, size, keep_empty)
    first = F.when(F.col("offset") == 0, F.lit(1 - k)).otherwise(F.lit(1))
    last = F.least(F.lit(size), F.length("piece") - k)
    gram = F.substr(F.col("piece"), F.greatest(F.col("_i"), F.lit(1)),
                    F.least(F.col("_i"), F.lit(1)) + k)
    return (
        cutted.filter((last >= first) | F.col("piece").isNull())
        .select(*keys, "offset", "piece", (F.explode_outer if keep_empty else F.explode)(
            F.sequence(first, last)).alias("_i"))
        .select(*keys, (F.col("offset") + F.col("_i") + k).alias("position"), gram.alias("gram"))
    )


def split_gram(gram: str = "gram") -> list[Column]:
    """Columns context and symbol of a gram."""
    return [F.substr(F.col(gram), F.lit(1), F.length(gram) - 1).alias("context"),
            F.right(F.col(gram), F.lit(1)).alias("symbol")]


def kgrams(df: DataFrame, keys: list[str], seq: str, k: int, size: int = PIECE) -> DataFrame:
    """Rows (keys, position, context, symbol), see ``grams``."""
    return grams(df, keys, seq, k, size).select(*keys, "position", *split_gram())
