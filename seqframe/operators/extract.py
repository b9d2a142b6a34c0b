"""Cutting parts out of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import cut, first_token, strand_cut
from ..session import cut_lineage, fits
from .letters import in_pieces, letters

#: Rows of requests (ids and places, no text) that travel to the sequences; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if fits(rows, BROADCAST_ROWS) else rows


def extract_intervals(seqs: DataFrame, requests: DataFrame, key: list[str], header: str = "header",
                      seq: str = "seq") -> DataFrame:
    """Ranges of all sequences whose header starts with a requested id.

    ``startswith`` has no equi-join, so each header is cut to every id length in use and
    joined on equality. Only headers take part in that join; sequences join afterwards on
    their ``key``, and only where something was requested.
    """
    matched = _matched(seqs.select(*key, header), requests, key, header)
    return seqs.join(_few(cut_lineage(matched, "requests")), key).select(
        *key, "id", "start", "end", F.col(header).alias("header"),
        cut(F.col(seq), F.col("start"), F.col("end")).alias("fragment"))


def _matched(heads: DataFrame, requests: DataFrame, key: list[str], header: str) -> DataFrame:
    """Rows (key, id, start, end): the requests whose id a header starts with."""
    wanted = requests.filter(F.length("id") > 0).select("id", "start", "end")
    # distinct lengths of ids: a handful of small integers, never more than the longest id
    lengths = [r[0] for r in wanted.select(F.length("id")).distinct().collect()]
    if not lengths:
        lengths = [0]
    pieces = F.array(*[
        F.when(F.length(header) >= n, F.substring(header, 1, n)) for n in sorted(lengths)])
    return (
        heads.select(*key, F.explode(pieces).alias("id"))
        .filter(F.col("id").isNotNull())
        .join(wanted, "id")
    )


def extract_intervals_pieces(parts: DataFrame, requests: DataFrame, key: str, header: str = "header") -> DataFrame:
    """``extract_intervals`` of sequences in pieces: rows (key, header, offset, piece), ``key`` telling sequences apart.

    Requests are cut at the borders of the pieces, meet each piece by its number and are put together again, so no row
    holds a sequence, and one with any share of the requests is spread by its pieces. What lies past the end is clipped.
    """
    heads = parts.groupBy(key).agg(F.first(header).alias(header))
    asked = cut_lineage(
        _matched(heads.select(key, header), requests, [key], header).join(heads, key)
        .withColumn("n", F.monotonically_increasing_id()), "requests")
    found = letters(asked, in_pieces(parts, key, "piece"), key, F.col("start") - 1, F.col("end"), "fragment")
    return asked.join(found, "n", "left").select(
        key, "id", "start", "end", header, F.coalesce("fragment", F.lit("")).alias("fragment"))


def extract_hits(hits: DataFrame, seqs: DataFrame, file: str = "file", header: str = "header",
                 seq: str = "seq", complemented: bool = False) -> DataFrame:
    """Hit ranges cut from the sequence whose first header word is the hit's id.

    A hit with start > end lies on the reverse strand and is reversed, and complemented
    on request.
    """
    named = seqs.select(file, first_token(F.col(header)).alias("id"), F.col(seq).alias("_seq"))
    return (
        named.join(_few(hits), [file, "id"])
        .withColumn("fragment", strand_cut(F.col("_seq"), F.col("start"), F.col("end"), complemented))
        .select(file, "id", F.length("fragment").alias("length"), "start", "end", "fragment")
    )
