"""Predicted targets of one miRNA in one tissue, supported by several tools.

Input tables and their columns:
  genes(refseq, chromosome, ch_start, ch_end, description)
  expression(gene, type, tissue)            gene is a unigene id
  targets(miRNA, gene, tool)                gene is a refseq id
  unigene_refseq(unigene, refseq)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _annotated(genes: DataFrame, expression: DataFrame, unigene_refseq: DataFrame,
               tissue: str) -> DataFrame:
    found = expression.filter(F.col("tissue") == tissue).select(
        F.col("gene").alias("unigene"), "type", "tissue")
    return (
        unigene_refseq.select("unigene", "refseq")
        .join(found, "unigene")
        .join(genes.select("refseq", "chromosome", "ch_start", "ch_end", "description"), "refseq")
    )


def _targets(targets: DataFrame, mirna: str) -> DataFrame:
    return targets.filter((F.col("miRNA") == mirna) & (F.col("miRNA") != "miRNA")).select(
        "miRNA", F.col("gene").alias("refseq"), "tool")


def support_rows(genes: DataFrame, expression: DataFrame, targets: DataFrame,
                 unigene_refseq: DataFrame, mirna: str, tissue: str) -> DataFrame:
    """The four-table join, one row per matching combination."""
    return _targets(targets, mirna).join(
        _annotated(genes, expression, unigene_refseq, tissue), "refseq"
    ).select("miRNA", "refseq", "unigene", "type", "tissue", "chromosome", "ch_start", "ch_end",
             "description", "tool")


def supporting_tools(targets: DataFrame, mirna: str, min_tools: int) -> DataFrame:
    """Genes named by at least ``min_tools`` different tools.

    Distinct (gene, tool) pairs first: a gene with very many rows is reduced before
    the shuffle and spread over its tools.
    """
    return (
        _targets(targets, mirna).distinct()
        .groupBy("refseq", "miRNA").agg(F.count("tool").alias("tool_count"))
        .filter(F.col("tool_count") >= min_tools)
    )


def support_join(genes: DataFrame, expression: DataFrame, targets: DataFrame,
                 unigene_refseq: DataFrame, mirna: str, tissue: str, min_tools: int = 3,
                 limit: int = 10) -> DataFrame:
    """The best supported genes with one row of attributes each.

    The join conditions do not involve the tool, so tools are counted below the join
    and only supported genes reach it. Of several attribute rows the greatest is kept.
    """
    attributes = ["unigene", "type", "tissue", "chromosome", "ch_start", "ch_end", "description"]
    described = _annotated(genes, expression, unigene_refseq, tissue).withColumn(
        "description", F.coalesce("description", F.lit("NULL")))
    return (
        supporting_tools(targets, mirna, min_tools)
        .join(described, "refseq")
        .groupBy("refseq", "miRNA", "tool_count")
        .agg(F.max(F.struct(*attributes)).alias("a"))
        .orderBy(F.desc("tool_count"), "refseq").limit(limit)
        .select("miRNA", F.col("refseq").alias("gene"), "a.*", "tool_count")
    )


def support_tools(report: DataFrame, targets: DataFrame, mirna: str) -> DataFrame:
    """The tools behind each gene of a ``support_join`` report, one row per gene and tool."""
    pairs = _targets(targets, mirna).select(F.col("refseq").alias("gene"), "tool")
    return pairs.join(report.select("gene", "tool_count"), "gene").select(
        "gene", "tool_count", "tool").distinct()
