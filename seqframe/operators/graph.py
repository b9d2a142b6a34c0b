"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Links ``(a, b)``, a > b, moved to the least neighbour of their centre.

    Large stars are centred on every node and move its larger neighbours; small stars move a node
    and its smaller neighbours. Neither joins or parts components.
    """
    if large:
        around = links.union(links.select(F.col("b"), F.col("a")))
    else:
        around = links
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = around.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (two long columns): root is the least node reachable.

    Stars are moved until nothing changes, which takes about log2(n) rounds whatever the diameter.
    Links from a node to itself and repeated links change nothing; a node must have a link to appear.
    """
    a, b = links.columns
    now = cut_lineage(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                      .filter(F.col("a") > F.col("b")).distinct(), "links")
    seen = None
    while True:
        now = cut_lineage(_stars(_stars(now, True), False), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
