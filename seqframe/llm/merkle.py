"""Merkle manifest of a dataset: a persistent tree with a version for each leaf that was tampered with.

Rows of a group, in the order of their ids, are the leaves of a tree in which eight neighbours have one parent;
the roots of the groups are the leaves of one more tree. A tree is grown in aligned blocks of four levels: a task
sees 4,096 neighbours and hands on the node above them, the next round does the same with those nodes, until one
is left. No task and no driver holds more of a tree, whatever share of the rows a group has.

The tree is never changed. A leaf with other content makes a version: the nodes between it and the root are
copied with their new digests, all others are those of the first tree. Inside its block a version finds the
siblings in the block; above, it goes on with the siblings that the upper rounds sent down to the block.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, task_count

ARITY = 8
#: Levels of an aligned block, so that it has ARITY ** LEVELS leaves.
LEVELS = 4
#: Leaves that a task orders.
ROWS = 1 << 20


def digest_of(fields: dict[str, Column]) -> Column:
    """SHA-256 (binary) of values, each as its length in bytes, a colon and itself; a null is a dash."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(nodes: list[bytes]) -> bytes:
    """The digest above neighbours: of their digests as lower-case hex text."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with ``index``, their place in their group by ``order``, and ``total``, the rows of the group.

    Ranges of (group, order) are numbered by themselves; what a group has in earlier ranges is one row per range
    and group. Rows that are equal in ``order`` are told apart by their place in the written table, so that no
    range can grow with them.
    """
    kept = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()), "unordered")
    parts = max(task_count(rows.sparkSession), -(-kept.count() // ROWS))
    keys = [group, *order, "_row"]
    # after the sort the same function numbers the rows of a range, with the range in the upper bits
    ordered = cut_lineage(
        kept.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row")
        .withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), "ordered")
    counts = ordered.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                            F.sum("_n").over(whole).alias("total"))
    # a row per range and group: written, so that the join knows how small it is
    return ordered.join(cut_lineage(offsets, "offsets"), [group, "_part"]).withColumn(
        "index", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def depth(total: int) -> int:
    """Levels above ``total`` leaves."""
    levels = 0
    while total > 1:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def grown(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """The levels of a block, from its leaves to its top."""
    out = [leaves]
    for _ in range(levels):
        out.append([parent(out[-1][i:i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


@dataclass
class Tree:
    """The rounds of a forest: nodes (``tree, index, total, digest``) from the leaves to the tops."""

    rounds: list[DataFrame]
    levels: int

    @property
    def tops(self) -> DataFrame:
        return self.rounds[-1].select("tree", "digest")

    def nodes(self) -> DataFrame:
        """All nodes of the first version: ``tree, level, index, digest``; leaves have level 0."""
        levels = self.levels

        def listed(low: int):
            def run(rows: pd.DataFrame) -> pd.DataFrame:
                rows = rows.sort_values("index")
                tree, at, total = rows["tree"].iloc[0], int(rows["index"].iloc[0]), int(rows["total"].iloc[0])
                found = grown([bytes(d) for d in rows["digest"]], min(levels, depth(total)))
                if depth(total) > levels:
                    found = found[:-1]  # the block's top is a node of the next round
                return pd.DataFrame(
                    [(tree, low + up, at // ARITY ** up + i, d) for up, layer in enumerate(found) for i, d in enumerate(layer)],
                    columns=["tree", "level", "index", "digest"])
            return run

        parts = []
        for number, nodes in enumerate(self.rounds[:-1]):
            alive = nodes if number == 0 else nodes.filter(F.col("total") > 1)
            parts.append(alive.select("tree", "index", "total", "digest").groupBy(
                "tree", F.floor(F.col("index") / ARITY ** levels).alias("_block")).applyInPandas(
                listed(number * levels), "tree string, level int, index long, digest binary"))
        return reduce(DataFrame.union, parts)


def build(leaves: DataFrame, levels: int = LEVELS) -> Tree:
    """Grow the trees of ``leaves`` (``tree, index, total, digest``), a round for every ``levels`` levels."""
    size = ARITY ** levels

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        total = int(rows["total"].iloc[0])
        found = grown([bytes(d) for d in rows["digest"]], min(levels, depth(total)))
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "index": [int(rows["index"].iloc[0]) // size],
                             "total": [-(-total // size)], "digest": [found[-1][0]]})

    rounds = [leaves]
    while True:
        nodes = rounds[-1].select("tree", "index", "total", "digest")
        above = nodes.groupBy("tree", F.floor(F.col("index") / size).alias("_block")).applyInPandas(
            top, "tree string, index long, total long, digest binary")
        rounds.append(cut_lineage(above, "nodes"))
        if (rounds[-1].agg(F.max("total")).first()[0] or 1) == 1:
            return Tree(rounds, levels)


PATH = "runs array<int>, places array<int>, proof binary"


def _siblings(layers: list[list[bytes]], i: int) -> tuple[list[int], list[int], list[bytes]]:
    """Size of the run, own place in it, and digests of the others, level by level up to the block's top."""
    runs, places, others = [], [], []
    for layer in layers[:-1]:
        begin = i // ARITY * ARITY
        run = layer[begin:begin + ARITY]
        runs.append(len(run))
        places.append(i - begin)
        others += run[:i - begin] + run[i - begin + 1:]
        i //= ARITY
    return runs, places, others


def fold(digest: bytes, runs: list[int], places: list[int], proof: bytes) -> list[bytes]:
    """The nodes from above a leaf to the root, if ``digest`` stands in the leaf's place: a version's copies."""
    out, at = [], 0
    for run, place in zip(runs, places):
        others = [proof[k:k + 32] for k in range(at, at + 32 * (run - 1), 32)]
        at += 32 * (run - 1)
        digest = parent([*others[:place], digest, *others[place:]])
        out.append(digest)
    return out


def _sent_down(tree: Tree, above: DataFrame, number: int, keep: list[str], more: str, finish) -> DataFrame:
    """Each node of round ``number`` with what its block's node got from above, and its siblings in the block."""
    levels, size, nodes = tree.levels, ARITY ** tree.levels, tree.rounds[number]
    block = F.floor(F.col("index") / size).alias("_block")

    def run(rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        rows, up = rows.sort_values("index", ignore_index=True), up.iloc[0]
        layers = grown([bytes(d) for d in rows["digest"]], min(levels, depth(int(rows["total"].iloc[0]))))
        out = []
        for i, row in enumerate(rows.itertuples(index=False)):
            runs, places, others = _siblings(layers, i)
            path = [*runs, *up["runs"]], [*places, *up["places"]], b"".join(others) + bytes(up["proof"])
            out.append(finish(row, up, path, layers))
        return pd.DataFrame(out, columns=[c.split(" ")[0].strip("`") for c in more.split(", ")])

    return nodes.select("tree", "index", "total", "digest", *keep).groupBy("tree", block).cogroup(
        above.select("tree", "index", "top", *(c.split(" ")[0] for c in PATH.split(", ")))
        .groupBy("tree", F.col("index").alias("_block"))).applyInPandas(run, more)


def paths(tree: Tree, above: DataFrame, keep: list[str], more: str, finish) -> DataFrame:
    """Rows for the leaves of a forest, made by ``finish(row, above, path, layers)``.

    ``above`` has ``tree, index, top`` and the path from each top on (``PATH``).
    """
    def go_on(row, up, path, layers):
        return row.tree, row.index, up["top"], *path

    # the tops of trees that end below are their own nodes in the rounds above
    for number in range(len(tree.rounds) - 2, 0, -1):
        above = cut_lineage(_sent_down(tree, above, number, [], f"tree string, index long, top binary, {PATH}", go_on), "paths")
    return _sent_down(tree, above, 0, keep, more, finish)


def manifest(docs: DataFrame, fields: list[str], id_column: str = "doc_id", group: str = "lang",
             changed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """The tree over ``docs``, a proof for each row, and a version for each row that ``changed`` makes another.

    A leaf is the digest of the ``fields`` of a row (``digest_of``). Leaves of a ``group`` ascend by id, equal
    ids by their digest. ``changed`` gives other values of columns: what is found in a row instead of what the
    manifest was made from. Returns per row: doc_id, lang (the group), index (place in the group), leaf, subroot,
    root, runs and places (sizes of the runs from leaf to root, and own places in them), proof (digests of the
    others of each run, level by level, left to right), copied (the nodes that the row's version does not share
    with the first tree, from the one above the leaf to the root; empty if nothing changed) and folded_root (the
    root from what was found and the proof). Digests are binary.

    A null group is a group like any other, the first one; a null id comes first in its group. Null fields have
    leaves too. Repeated rows are leaves side by side. Other columns are ignored. No rows: no rows.
    """
    new = {c: (changed or {}).get(c, F.col(c)) for c in fields}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(id_column).alias("id"), F.col(id_column).cast("string").alias("name"), digest_of({c: F.col(c) for c in fields}).alias("digest"),
        digest_of(new).alias("found"))
    kind = leaves.schema["id"].dataType.simpleString()
    placed = cut_lineage(ranked(leaves, "tree", ["id", "digest"]), "leaves")
    forest = build(placed, levels)
    subroots = forest.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = build(cut_lineage(ranked(subroots, "tree", ["name"]), "subroots"), levels)
    none = F.array().cast("array<int>")
    above = upper.tops.select("tree", F.lit(0).cast("long").alias("index"), F.col("digest").alias("top"),
                              none.alias("runs"), none.alias("places"), F.lit(b"").alias("proof"))
    first = upper.tops.select("digest").first()
    root = bytes(first[0]) if first else b""

    def of_subroot(row, up, path, layers):
        return row.name, 0, row.digest, *path

    roots = paths(upper, above, ["name"], f"tree string, index long, top binary, {PATH}", of_subroot)

    def of_leaf(row, up, path, layers):
        folded = fold(bytes(row.found), *path)
        # what is equal is shared: the versions of leaves that are as they were own no node
        copied = folded if row.found != row.digest else []
        return (row.name, row.tree, row.index, row.digest, up["top"], *path, copied, folded[-1] if folded else row.found)

    found = paths(forest, cut_lineage(roots, "roots"), ["name", "found"],
                  f"name string, tree string, index long, leaf binary, subroot binary, {PATH}, "
                  "copied array<binary>, folded_root binary", of_leaf)
    return found.select(
        F.col("name").cast(kind).alias("doc_id"), F.when(F.col("tree") != "", F.expr("substr(tree, 2)")).alias("lang"), "index", "leaf",
        "subroot", F.lit(root).alias("root"), "runs", "places", "proof", "copied", "folded_root")


def version_nodes(found: DataFrame) -> DataFrame:
    """The nodes that versions own: ``doc_id, lang, level, place, digest``, a row for each copied node.

    ``place`` is the one in its run (null for the root). All other nodes of a version are those of the first tree.
    """
    return found.select("doc_id", "lang", "places", F.posexplode("copied").alias("_up", "digest")).select(
        "doc_id", "lang", (F.col("_up") + 1).alias("level"), F.get("places", F.col("_up") + 1).alias("place"), "digest")
