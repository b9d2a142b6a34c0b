"""Tab-separated inputs, relational sources and saved models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .records import read_records


def read_intervals(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Requests (id, start, end) of a tab file with a header row. Blank rows are dropped."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="id string, start long, end long",
                          enforceSchema=True)
    return rows.filter(F.trim("id") != "")


def wide_to_vectors(wide: DataFrame) -> DataFrame:
    """First column as ``name``, all others as one array ``vec``; a cell without a number is 0."""
    name, *samples = wide.columns
    numbers = [F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) for c in samples]
    return wide.select(F.col(f"`{name}`").alias("name"), F.array(*numbers).alias("vec"))


def read_matrix(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Expression matrix (name, vec): header row of sample names, ids in the first column."""
    return wide_to_vectors(spark.read.csv(path, sep="\t", header=True))


def read_substitutions(spark: SparkSession, path: str, scale: float = 0.0001) -> DataFrame:
    """Substitution matrix as (i, j, value); stored values are multiplied by ``scale``."""
    wide = spark.read.csv(path, sep="\t", header=True)
    name, *symbols = wide.columns
    return wide.unpivot(F.col(f"`{name}`").alias("i"), [F.col(f"`{s}`") for s in symbols], "j", "value") \
        .select("i", "j", (F.col("value").cast("double") * scale).alias("value"))


def read_tracking(spark: SparkSession, path: str | list[str], id_column: int = 0,
                  value_column: int = 10) -> DataFrame:
    """Tracking file as (file, split, row, gene, chr, value): columns by place, first line skipped.

    A value that is no number is NULL and its row stays, so it counts as a row of its group.
    The chromosome is the number before a colon; lines without one have NULL (see
    ``fill_forward`` for the older habit of taking the line above).
    """
    lines = read_records(spark, path, header=True)
    fields = F.split("value", "\t")
    return lines.select(
        "file", "split", "row",
        F.get(fields, F.lit(id_column)).alias("gene"),
        F.nullif(F.regexp_extract("value", r"(\d+):", 1), F.lit("")).alias("chr"),
        F.get(fields, F.lit(value_column)).try_cast("double").alias("value"))


def read_motifs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Aligned motifs (name, motif): the first word of bases in each line.

    All motifs must have the same length.
    """
    lines = read_records(spark, path)
    found = lines.select(
        F.regexp_extract("value", r"^(\S*)", 1).alias("name"),
        F.upper(F.regexp_extract("value", r"\b([ACGTacgt]+)\b", 1)).alias("motif")
    ).filter(F.col("motif") != "")
    shortest, longest = found.agg(F.min(F.length("motif")), F.max(F.length("motif"))).first()
    if shortest != longest:
        raise ValueError(f"motifs have lengths from {shortest} to {longest}")
    return found


def read_tables(spark: SparkSession, names: list[str], folder: str | None = None,
                jdbc: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables of a database, from Parquet files in a folder or over JDBC.

    ``jdbc`` holds the options of Spark's JDBC source (url, user, password, and for large
    tables partitionColumn, lowerBound, upperBound, numPartitions).
    """
    if jdbc:
        return {n: spark.read.format("jdbc").options(**jdbc).option("dbtable", n).load() for n in names}
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("context string, symbol string, n long").parquet(path)
