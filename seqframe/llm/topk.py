"""Exact top-k search in three phases with one safe cutoff per query.

Vectors lie in blocks. (1) Each block gives every query a short local list of its best scores. The
k-th best score of all lists of a query is safe: at least k rows reach it. (2) Each block gets that
cutoff and gives all rows that reach it. Both phases score a block of queries against a block of rows
as one product of matrices in single precision; the cutoff is lowered by a bound of the rounding
error, so no row is lost. (3) The scores of the rows collected are resolved exactly, as integers, and
ranked.

Queries are read in blocks from the shared folder: memory holds one block of rows and one of queries.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, task_count
from . import blocks as B

BLOCK_ROWS, QUERY_ROWS = 2048, 1024


def quantized(vec: str, factor: int = 64):
    """floor(factor * x) of every component, as doubles; null where a component is not finite."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    whole = F.transform(vec, lambda v: _floor(v.cast("double") * factor))
    return F.when(F.col(vec).isNotNull() & ~bad, whole)


def _floor(v):
    """Floor that stays a double: components beyond the range of long are whole numbers already."""
    return F.when(F.abs(v) < 2.0 ** 53, F.floor(v).cast("double")).otherwise(v)


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of equal width; components that a shorter vector lacks are zero."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def _store(rows: DataFrame, home: str, size: int) -> DataFrame:
    """Blocks of ids and vectors as files of the shared folder: ``uri, rows, width``."""
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, number, ids, vectors = TaskContext.get().partitionId(), 0, [], []

        def flush() -> pd.DataFrame:
            uri = f"{home}/{part:06d}-{number:06d}"
            width = max(map(len, vectors))
            B.put(uri, pickle.dumps((np.array(ids, np.int64), _matrix(vectors, width))))
            return pd.DataFrame({"uri": [uri], "rows": [len(ids)], "width": [width]})

        for f in frames:
            for i, v in zip(f["id"], f["vec"]):
                ids.append(i)
                vectors.append(np.asarray(v, float))
                if len(ids) == size:
                    yield flush()
                    number, ids, vectors = number + 1, [], []
        if ids:
            yield flush()

    return cut_lineage(rows.mapInPandas(write, "uri string, rows long, width int"), "vectors")


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    return rows.repartition(max(1, -(-rows.count() // size)))


def _single(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores in single precision, and for each query a bound of their error."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 1e15:
        scores = (q.astype(np.float32) @ x.astype(np.float32).T).astype(float)
        error = 2.0 ** -23 * (width + 4)
    else:
        scores, error = q @ x.T, 2.0 ** -52 * (width + 4)
    return scores, error * np.linalg.norm(q, axis=1) * (np.linalg.norm(x, axis=1).max(initial=0) + 1)


def _exact(a: np.ndarray, b: np.ndarray) -> int:
    """Inner product of whole numbers, held within the range of long."""
    n = min(len(a), len(b))
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(n, 1) < 2.0 ** 53:
        return int(a[:n] @ b[:n])
    value = sum(int(x) * int(y) for x, y in zip(a[:n], b[:n]))
    return max(-(1 << 63), min((1 << 63) - 1, value))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query.

    Both inputs have columns ``id`` (long) and ``vec`` (array of whole doubles). Candidates of a query
    are all rows with another id. Ties go to the smaller id. Rows whose id or vector is null take no
    part; a component that one vector lacks counts as zero. A repeated query counts once; a repeated
    row is a candidate each time. Fewer candidates than k: all of them. No queries: no rows.
    """
    spark = rows.sparkSession
    rows = rows.filter("id is not null and vec is not null")
    queries = queries.filter("id is not null and vec is not null").dropDuplicates(["id"])
    home = B.folder(spark, "topk")
    tasks = task_count(spark)
    # blocks are counted by their rows: more tasks do not make more lists
    stored = _store(_dealt(rows, BLOCK_ROWS), f"{home}/rows", BLOCK_ROWS)
    asked = _store(_dealt(queries, QUERY_ROWS), f"{home}/queries", QUERY_ROWS)
    blocks = max(1, stored.count())
    asked_uris = [r[0] for r in asked.select("uri").collect()]  # one name per QUERY_ROWS queries
    # a list as long as this from each block holds the k best of most queries
    short = min(k, -(-3 * k // blocks) + 2)

    def local_lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for uri in f["uri"]:
                ids, x = pickle.loads(B.get(uri))
                for at in asked_uris:
                    q_ids, q = pickle.loads(B.get(at))
                    scores, error = _single(q, x)
                    scores -= error[:, None]  # never above the true score
                    scores[q_ids[:, None] == ids[None, :]] = -np.inf
                    n = min(short, len(ids))
                    best = -np.partition(-scores, n - 1, axis=1)[:, :n]
                    frame = pd.DataFrame({"query_id": np.repeat(q_ids, n), "score": best.ravel()})
                    yield frame[np.isfinite(frame["score"])]

    lists = stored.select("uri").repartition(tasks, "uri").mapInPandas(local_lists, "query_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    kth = (lists.withColumn("n", rank).filter(F.col("n") <= k).groupBy("query_id")
           .agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")))
    # fewer than k scores gathered: every row is wanted
    kth = kth.select("query_id", F.when(F.col("n") == k, F.col("cutoff")).otherwise(float("-inf")).alias("cutoff"))
    cutoffs = cut_lineage(asked.select("uri").mapInPandas(_ids_of, "uri string, query_id long")
                          .join(kth, "query_id", "left").fillna(float("-inf"), ["cutoff"]), "cutoffs")

    def write_cutoffs(f: pd.DataFrame) -> pd.DataFrame:
        uri = f["uri"].iloc[0]
        B.put(uri + ".cutoff", pickle.dumps(dict(zip(f["query_id"].tolist(), f["cutoff"].tolist()))))
        return pd.DataFrame({"uri": [uri]})

    cutoffs.groupBy("uri").applyInPandas(write_cutoffs, "uri string").count()

    def sufficient(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for uri in f["uri"]:
                ids, x = pickle.loads(B.get(uri))
                for at in asked_uris:
                    q_ids, q = pickle.loads(B.get(at))
                    cutoff = pickle.loads(B.get(at + ".cutoff"))
                    scores, error = _single(q, x)
                    low = np.array([cutoff[i] for i in q_ids.tolist()])
                    reach = (scores + error[:, None] >= low[:, None]) & (q_ids[:, None] != ids[None, :])
                    a, b = np.nonzero(reach)
                    exact = _resolve(q, x, a, b)
                    # however many rows of the block tie at the cutoff, the k best of them suffice
                    order = np.lexsort((ids[b], ~exact, a))  # ~ turns the order round and cannot overflow
                    a, b, exact = a[order], b[order], exact[order]
                    place = np.arange(len(a)) - np.searchsorted(a, a, "left")
                    best = place < k
                    yield pd.DataFrame({"query_id": q_ids[a[best]], "vec_id": ids[b[best]], "score": exact[best]})

    found = stored.select("uri").repartition(tasks, "uri").mapInPandas(
        sufficient, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ids_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for uri in f["uri"]:
            ids, _ = pickle.loads(B.get(uri))
            yield pd.DataFrame({"uri": uri, "query_id": ids})


def _resolve(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs of rows ``a`` of ``q`` and ``b`` of ``x``."""
    n = min(q.shape[1], x.shape[1])
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(n, 1) < 2.0 ** 53:
        return np.concatenate([np.einsum("ij,ij->i", q[a[i:i + 4096], :n], x[b[i:i + 4096], :n])
                               for i in range(0, len(a), 4096)] or [np.empty(0)]).astype(np.int64)
    return np.array([_exact(q[i], x[j]) for i, j in zip(a, b)], np.int64)
