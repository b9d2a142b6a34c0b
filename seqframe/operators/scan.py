"""Order-dependent operators that never put a whole group into one task.

Each one works in two levels: inside buckets of bounded size, and over one summary
row per bucket. ``bucket`` must not decrease along the order inside a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def fill_forward(df: DataFrame, values: str | list[str], group: str, order: str,
                 bucket: Column) -> DataFrame:
    """Each of ``values`` replaced by the last non-null one at or before the row in its group."""
    names = [values] if isinstance(values, str) else values
    inside = Window.partitionBy(group, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = df.withColumn("_bucket", bucket)
    carried = rows.groupBy(group, "_bucket").agg(*[
        F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_last_{v}") for v in names
    ]).select(group, "_bucket", *[
        F.last(f"_last_{v}", True).over(across).alias(f"_carried_{v}") for v in names])
    return (
        rows.join(carried, [group, "_bucket"])
        .withColumns({v: F.coalesce(F.last(v, True).over(inside), F.col(f"_carried_{v}"))
                      for v in names})
        .drop("_bucket", *[f"_carried_{v}" for v in names])
    )


def with_next(df: DataFrame, value: str, group: str, bucket: str, order: str, out: str) -> DataFrame:
    """``value`` of the following row of the group, also across buckets."""
    inside = Window.partitionBy(group, bucket).orderBy(order)
    first = df.groupBy(group, bucket).agg(F.min_by(value, order).alias("_first"))
    across = first.select(group, bucket, F.lead("_first").over(
        Window.partitionBy(group).orderBy(bucket)).alias("_following"))
    return df.join(across, [group, bucket]).withColumn(
        out, F.coalesce(F.lead(value).over(inside), F.col("_following"))).drop("_following")


def running_total(df: DataFrame, value: str, group: str, order: Column, bucket: Column,
                  out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group (the row excluded)."""
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(group, "_bucket").orderBy(order).rowsBetween(*before)
    across = Window.partitionBy(group).orderBy("_bucket").rowsBetween(*before)
    rows = df.withColumn("_bucket", bucket)
    offsets = (
        rows.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
        .select(group, "_bucket", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_offset"))
    )
    return (
        rows.join(offsets, [group, "_bucket"])
        .withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def running_max(df: DataFrame, value: str, number: str, out: str, bucket_rows: int = 100_000) -> DataFrame:
    """Greatest ``value`` of the rows before each row; ``number`` counts the rows from 1."""
    before = (Window.unboundedPreceding, -1)
    rows = df.withColumn("_bucket", F.floor((F.col(number) - 1) / bucket_rows))
    tops = rows.groupBy("_bucket").agg(F.max(value).alias("_top"))  # one row per bucket
    earlier = tops.select("_bucket", F.max("_top").over(Window.orderBy("_bucket").rowsBetween(*before)).alias("_earlier"))
    inside = Window.partitionBy("_bucket").orderBy(number).rowsBetween(*before)
    return rows.join(earlier, "_bucket").withColumn(
        out, F.greatest(F.max(value).over(inside), F.col("_earlier"))).drop("_bucket", "_earlier")


def number_rows(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Row numbers 1..n in a global order, without a global one-task window.

    A range sort decides the parts; the part sizes (one row each) give the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()),
        "ranged")
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    # one row per shuffle partition, so the broadcast is bounded by a setting
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.row_number().over(inside) + F.col("_offset"))
        .drop("_part", "_offset")
    )
