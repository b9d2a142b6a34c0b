"""Everyday tables seen as sequences, hits, targets and vectors.

Letters of text become sequences, events and orders become hits and targets. Nothing is
left out: every view covers the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dna_view, translate_codons
from ..session import spread

# Residues in classes, for a small rule-based substitution table.
CLASSES = ["AGPST", "C", "DENQ", "FWY", "HKR", "ILMV"]
SAME, SIMILAR, DIFFERENT = 4, 1, -2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_dna(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "source", dna_view(F.col("text")).alias("seq"))


def document_fasta(spark: SparkSession, folder: str) -> DataFrame:
    header = F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(" "), "source")
    return document_dna(spark, folder).select("doc_id", "source", header.alias("header"), "seq")


def benchmark_dna(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select("item_id", dna_view(F.col("text")).alias("seq"))


def document_proteins(spark: SparkSession, folder: str) -> DataFrame:
    return document_dna(spark, folder).select("doc_id", translate_codons(F.col("seq")).alias("seq"))


def benchmark_proteins(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_dna(spark, folder).select("item_id", translate_codons(F.col("seq")).alias("seq"))


def event_hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("contig"), F.col("event_type").alias("gene"),
        F.col("value").alias("evalue"), F.col("event_id").alias("line_no"))


def event_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Every event type but one has a description."""
    return table(spark, folder, "events").filter(F.col("event_type") != "error").select(
        F.col("event_type").alias("gene"), F.col("props").alias("description"),
        F.col("event_id").alias("line_no"))


def targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("miRNA"), F.col("l_orderkey").alias("gene"),
        F.col("l_suppkey").alias("tool"))


def target_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    """(genes, expression, targets, unigene_refseq) from orders, customers and lines."""
    orders = table(spark, folder, "orders")
    genes = orders.select(
        F.col("o_orderkey").alias("refseq"), F.col("o_orderpriority").alias("chromosome"),
        F.col("o_custkey").alias("ch_start"), (F.col("o_custkey") + 100).alias("ch_end"),
        F.nullif("o_orderstatus", F.lit("P")).alias("description"))
    expression = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").alias("gene"), F.col("n_name").alias("type"),
             F.col("c_mktsegment").alias("tissue"))
    unigene = orders.select(F.col("o_custkey").alias("unigene"), F.col("o_orderkey").alias("refseq"))
    return genes, expression, targets(spark, folder), unigene


def order_motifs(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates as eight digits, and the digits as bases: motifs of equal length."""
    digits = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("name"),
        F.translate(digits, "0123456789", "ACGTACGTAC").alias("motif"))


def nation_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the lines ordered in nation i that come from suppliers of nation j."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("i"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("j"))
    counts = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("i").agg(F.sum("n").alias("total"))
    return counts.join(totals, "i").select("i", "j", (F.col("n") / F.col("total")).alias("value"))


def nation_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of all suppliers in each nation."""
    suppliers = table(spark, folder, "supplier")
    total = suppliers.count()
    return suppliers.groupBy(F.col("s_nationkey").alias("symbol")).agg(
        (F.count(F.lit(1)) / F.lit(total)).alias("frequency"))


def class_scores(spark: SparkSession) -> DataFrame:
    symbols = sorted("".join(CLASSES))
    group = {s: i for i, c in enumerate(CLASSES) for s in c}
    rows = [(a, b, SAME if a == b else SIMILAR if group[a] == group[b] else DIFFERENT)
            for a in symbols for b in symbols]
    return spark.createDataFrame(rows, "a string, b string, score int")


def embedding_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def part_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity of each brand ordered per calendar month: (brand, vec of 12)."""
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_quantity", "l_shipdate")
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    month = F.month("l_shipdate")
    sums = [F.sum(F.when(month == m, F.col("l_quantity")).otherwise(0.0)) for m in range(1, 13)]
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("brand").agg(
        F.array(*sums).alias("vec"))
