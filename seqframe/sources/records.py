"""Text files as records with a place: which file, which split, which row of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_records(spark: SparkSession, path: str | list[str], separator: str | None = None,
                 pattern: str | None = None, header: bool = False) -> DataFrame:
    """Rows (file, split, row, value); with ``header`` without the first line of each file.

    ``split`` is the byte offset of the input split and ``row`` grows inside it, so
    (split, row) orders the records of a file without shuffling them.
    """
    reader = spark.read
    if separator:
        reader = reader.option("lineSep", separator)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if header:
        # a line is one field, as no text holds the separator; this reader knows first lines by place
        lines = reader.csv(path, schema="value string", sep="\x01", quote="", header=True)
    else:
        lines = reader.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        "value")
