"""Blocks: bounded groups of documents in the shared scratch folder, and exchanges between them.

Some operators must know, for every key of a text (word pairs, anchors of repeats), a number
gathered over the whole corpus. Shuffling a row per key and joining it back would move many
times the corpus. Instead a task groups documents to blocks of bounded size, keeps each block
as one file in the shared folder, and sends the block's distinct keys, sorted and compressed,
to key buckets. A bucket merges what all blocks sent and answers each block with numbers in the
order in which its keys came. So a key that half of the corpus holds is one entry of a block,
and no task sees more than one block or one bucket.

Block files are named by partition and number and are written whole before they get their name:
a task that runs again writes the same file, and nothing depends on an executor that may be lost.
"""

from __future__ import annotations

import ctypes
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, task_count

#: Bytes of text in a block, and of text whose keys go to one bucket.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 10 << 20

#: Stands for a null id in Python, where a null would make an inexact float of every id of its batch.
NO_ID = -(1 << 63)

SENT = "bucket int, block string, payload binary"


#: Bytes of a batch that Spark hands to Python.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark cut batches for Python by bytes: texts may be long, and 10,000 of them too much at once.

    The setting of the session is lowered, never raised.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name, None) or f"{64 << 20}").lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def give_back() -> None:
    """Return what Python no longer needs to the system: workers live on after a task, and so would their memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """The same function over the batches of a task, which gives memory back at its end."""
    def leaner(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return leaner


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write a file of the shared folder; it gets its name when it is whole."""
    files, path = _open(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, path)


def get(uri: str) -> bytes:
    files, path = _open(uri)
    with files.open_input_file(path) as f:
        return f.read()


def get_range(uri: str, offset: int, length: int) -> bytes:
    """``length`` bytes of a file from ``offset`` on; nothing else is read."""
    files, path = _open(uri)
    with files.open_input_file(path) as f:
        return f.read_at(length, offset)


def folder(spark: SparkSession, label: str) -> str:
    path = scratch_path(spark, label)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: their byte planes, compressed."""
    planes = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes())
              if len(a) else (a.dtype.str, b"") for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, protocol=5))


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, planes in pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(data))):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(
            np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()
            if planes else np.empty(0, kind))
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, which compress well; ``np.cumsum`` gives the keys back."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def smallest(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64)
                              if top <= np.iinfo(t).max))


def numbered(column: str) -> Column:
    """A column of ids for Python, without nulls."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def renamed(column: str) -> Column:
    """Ids that come from Python, nulls again."""
    return F.nullif(F.col(column), F.lit(NO_ID))


def bucket_count(docs: DataFrame, column: str = "text") -> int:
    """Buckets of bounded size for the keys of a text column: they grow with its bytes."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(task_count(docs.sparkSession), -(-size // BUCKET_BYTES))


def split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Places where each bucket's part of the sorted 64-bit keys begins, and the end."""
    bounds = np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets + 1)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def sends(block: str, keys: np.ndarray, values: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """A row per bucket with the block's part of the sorted ``keys`` and their values.

    The first bucket always hears of the block, so that a block without keys is answered too.
    """
    cuts = split(keys, buckets)
    heard = np.flatnonzero((cuts[1:] > cuts[:-1]) | (np.arange(buckets) == 0))
    rows = [(i, block, pack(steps(keys[a:b]), *[smallest(v[a:b]) if v.dtype.kind == "u" else v[a:b]
                                                for v in values]))
            for i, a, b in zip(heard.tolist(), cuts[heard].tolist(), cuts[heard + 1].tolist())]
    return pd.DataFrame(rows, columns=["bucket", "block", "payload"])


def exchange(sent: DataFrame, merge: Callable, cut: Callable = list) -> DataFrame:
    """Answers of the buckets to the blocks, in the columns of ``SENT``.

    ``merge(keys, *values)`` sees the entries of one bucket, block after block, and returns an answer
    per entry: a list of arrays as long as ``keys``, or what ``cut`` makes of it for the entries of a
    block, and a list of extra ``(block name, arrays)`` answers.
    """
    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        parts = [unpack(p) for p in rows["payload"]]
        ends = np.cumsum([0, *(len(p[0]) for p in parts)])
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        values = [np.concatenate([p[i] for p in parts]) for i in range(1, len(parts[0]))]
        names, bucket = list(rows["block"]), int(rows["bucket"].iloc[0])
        del parts, rows
        answers, more = merge(keys, *values)
        out = [(bucket, n, pack(*cut([x[a:b] for x in answers]))) for n, a, b in zip(names, ends, ends[1:])]
        out += [(bucket, n, pack(*a)) for n, a in more]
        return pd.DataFrame(out, columns=["bucket", "block", "payload"])

    return sent.groupBy("bucket").applyInPandas(reduce, SENT)


def by_block(rows: DataFrame):
    """Answers grouped by block, over as many tasks as there are: a block is much work for few bytes."""
    return rows.repartition(task_count(rows.sparkSession), "block").groupBy("block")


def answers_of(rows: pd.DataFrame) -> list[list[np.ndarray]]:
    """A block's answers in the order of the buckets, which is that of its keys."""
    return [unpack(p) for p in rows.sort_values("bucket")["payload"]]


def batches(frames: Iterator[pd.DataFrame], name: str, limit: int = BLOCK_BYTES
            ) -> Iterator[tuple[str, list, list[bytes]]]:
    """Block name, ids and UTF-8 texts (null: empty) of the rows ``(id, ..., text)`` of one partition.

    With columns between id and text an id is the tuple of all columns before the text.

    A text is never cut, so a block holds at most ``limit`` bytes and one text more.
    """
    from pyspark import TaskContext
    part, number, size, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []
    for frame in frames:
        *names, last = frame.columns
        keys = frame[names[0]] if len(names) == 1 else zip(*(frame[n] for n in names))
        for key, text in zip(keys, frame[last]):
            data = text.encode() if isinstance(text, str) else b""
            ids.append(key)
            texts.append(data)
            size += len(data) + 16
            if size >= limit:
                yield f"{name}/{part:06d}-{number:06d}", ids, texts
                number, size, ids, texts = number + 1, 0, [], []
    if ids:
        yield f"{name}/{part:06d}-{number:06d}", ids, texts


class Writer:
    """A file of the shared folder written piece by piece; it gets its name when it is whole."""

    def __init__(self, uri: str) -> None:
        self.files, self.path = _open(uri)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part, self.size = f"{self.path}.{uuid.uuid4().hex}", 0
        self.out = self.files.open_output_stream(self.part)

    def write(self, data: bytes) -> tuple[int, int]:
        """Append; returns offset and length."""
        self.out.write(data)
        self.size += len(data)
        return self.size - len(data), len(data)

    def close(self) -> None:
        self.out.close()
        self.files.move(self.part, self.path)


class Reader:
    """Range reads of one file; a range that goes on where the last one ended is read ahead."""

    def __init__(self, uri: str, ahead: int = 1 << 20) -> None:
        files, path = _open(uri)
        self.file, self.ahead, self.at, self.held = files.open_input_file(path), ahead, 0, b""

    def read(self, offset: int, length: int) -> bytes:
        if not self.at <= offset <= offset + length <= self.at + len(self.held):
            more = self.ahead if offset == self.at + len(self.held) or self.held == b"" else 0
            if self.at <= offset < self.at + len(self.held):
                more = self.ahead
            self.at, self.held = offset, self.file.read_at(max(length, more), offset)
        return self.held[offset - self.at:offset - self.at + length]

    def close(self) -> None:
        self.file.close()
