"""Hit tables from search reports.

Hits are long rows (contig, gene, evalue, order column). Lists per gene or query stay
long too; only the text sinks put them on one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import evalue_number


def _last_values(hits: DataFrame, order: str, cutoff: float) -> DataFrame:
    below = evalue_number(F.col("evalue")) < cutoff
    return hits.groupBy("contig", "gene").agg(
        F.max_by("evalue", order).alias("evalue"),
        F.count_if(below).alias("_below"),
    )


def best_hits(hits: DataFrame, descriptions: DataFrame, order: str, cutoff: float) -> DataFrame:
    """Last e-value of each contig and gene if it is below ``cutoff``, with the gene's text.

    The last description of a gene wins; a gene without one has NULL.
    """
    latest = descriptions.groupBy("gene").agg(F.max_by("description", order).alias("description"))
    return (
        _last_values(hits, order, cutoff)
        .filter(evalue_number(F.col("evalue")) < cutoff)
        .join(latest, "gene", "left")
        .select("contig", "gene", "description", "evalue")
    )


def multi_contig_hits(hits: DataFrame, order: str, cutoff: float, more_than: int = 1) -> DataFrame:
    """All contigs of every gene that has more than ``more_than`` hits below ``cutoff``."""
    pairs = _last_values(hits, order, cutoff)
    wanted = pairs.groupBy("gene").agg(F.sum("_below").alias("n_below")).filter(
        F.col("n_below") > more_than)
    return pairs.join(wanted, "gene").select("gene", "n_below", "contig", "evalue")


def query_hits(queries: DataFrame, subjects: DataFrame, on: str | list[str],
               with_no_hits: bool = True) -> DataFrame:
    """Queries with one row per subject; a query without hits keeps one row of NULLs."""
    found = queries.join(subjects, on)  # an inner join: a query with very many hits is split
    if not with_no_hits:
        return found
    return found.unionByName(query_nohits(queries, subjects, on), allowMissingColumns=True)


def query_nohits(queries: DataFrame, subjects: DataFrame, on: str | list[str]) -> DataFrame:
    keys = [on] if isinstance(on, str) else on
    return queries.join(subjects.select(*keys).distinct(), on, "left_anti")


def high_scoring(hits: DataFrame, bits: Column, at_least: int = 100) -> DataFrame:
    """Summary rows with a bit score of three digits or more."""
    return hits.filter(bits >= at_least)
