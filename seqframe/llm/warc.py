"""WARC archives with a two-level capture index.

Captures are sorted by their key, the URL with its host reversed (``com,example,www)/path``), and their id. Each
task writes one archive of single-record gzip members, and beside it the level-one index: the sorted keys with
offset and length of the record, in compressed blocks. Level two is a sparse directory: the first key of each
block. A look-up searches the archives' first keys, then the directory of one archive, then one block by
bisection, and reads exactly the ranges of the block and of the record.
"""

from __future__ import annotations

import gzip
import hashlib
import pickle
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, task_count
from . import blocks as B

#: Captures in a block of the index.
BLOCK_LINES = 512
#: Payloads from this size on are written once; equal ones after the first are revisits.
REVISIT_BYTES = 100

_CONTROL = re.compile(r"[\x00-\x1f\x7f]")

RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long")


def reversed_host_key(url: str | None) -> str:
    """Sort key of a URL: host parts from the right, port, path and query. Null: empty."""
    plain = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", (url or "").strip())
    try:
        parts = urlsplit(plain)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return plain
    if not host:
        return plain
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", str(v)) for k, v in fields]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, size: int, digest: str, payload: bytes | None,
           refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit of another record with the headers only."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    body = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)])
    fields: list[tuple[str, object]] = [("WARC-Type", "revisit" if payload is None else "response"),
                                        ("WARC-Record-ID", name(page_id)), ("WARC-Date", "2026-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if payload is None:
        fields += [("WARC-Refers-To", name(refers_to)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    else:
        body += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    return b"WARC/1.1\r\n" + _header(fields) + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def _id(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if re.fullmatch(r"-?\d+", number) else None


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record; a body that is not whole is refused."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    body = rest[:int(fields["Content-Length"])]
    if len(body) < int(fields["Content-Length"]) or rest[len(body):] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is not whole")
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def captures(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Pages with key, size and digest (``kind`` 1), and ahead of those that repeat the payload of another
    page a row (``kind`` 0) with the id that they refer to. Payloads stay where they are read until
    the one sort that the archives need; what is equal is found out on digests alone."""
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = _keyed(rows).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    long = rows.filter(F.col("size") >= REVISIT_BYTES).select("key", "number", "page_id", "digest")
    first = (long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
             .filter("copies > 1 and refers_to is not null").select("digest", "refers_to"))
    again = (long.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
             .select("key", "number", F.lit(0).alias("kind"), "digest", "refers_to").distinct())
    whole = rows.select("key", "number", F.lit(1).alias("kind"), "digest", F.lit(B.NO_ID).alias("refers_to"),
                        "url", "size", "payload")
    return whole.unionByName(again, allowMissingColumns=True)


def _keyed(rows: DataFrame) -> DataFrame:
    key = F.pandas_udf(lambda urls: urls.map(lambda u: reversed_host_key(u if isinstance(u, str) else None)), "string")
    return rows.withColumn("key", key("url")).withColumn("number", B.numbered("page_id"))


def write(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url",
          payload: str = "html") -> DataFrame:
    """Write archives and their indexes below ``path``; returns a row per archive with its first key.

    Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the smallest id is a response, the
    others revisit it; smaller payloads are responses each. Null payloads are empty, null URLs have an empty
    key, null ids sort first and are never referred to unless all are null. Rows that repeat the smallest id
    are responses too. Other columns are ignored.
    """
    spark = pages.sparkSession
    B.bounded_batches(spark)

    def archive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        name = f"{path}/part-{TaskContext.get().partitionId():05d}"
        out = index = None
        lines: list[tuple[str, int, int, int]] = []
        directory: list[tuple[tuple[str, int], int, int]] = []

        def close_block() -> None:
            data = "\n".join(f"{n}\t{o}\t{s}\t{k}" for k, n, o, s in lines).encode()
            directory.append(((lines[0][0], lines[0][1]), *index.write(zlib.compress(data))))
            lines.clear()

        place, refers = None, {}
        for f in frames:
            for r in f.itertuples(index=False):
                if (r.key, r.number) != place:
                    place, refers = (r.key, r.number), {}
                if r.kind == 0:
                    refers[r.digest] = int(r.refers_to)
                    continue
                if out is None:
                    out, index = B.Writer(f"{name}.warc.gz"), B.Writer(f"{name}.idx")
                own = None if r.number == B.NO_ID else int(r.number)
                again = refers.get(r.digest)
                data = record(own, r.url if isinstance(r.url, str) else None, int(r.size), r.digest,
                              bytes(r.payload) if again is None else None, again)
                # equal captures stay in one block
                if len(lines) >= BLOCK_LINES and place != lines[-1][:2]:
                    close_block()
                lines.append((*place, *out.write(gzip.compress(data, 6, mtime=0))))
        if out is not None:
            close_block()
            out.close()
            index.close()
            B.put(f"{name}.dir", pickle.dumps(directory))
            yield pd.DataFrame({"archive": [name], "key": [directory[0][0][0]], "number": [directory[0][0][1]],
                                "blocks": [len(directory)]})

    rows = captures(pages, id_column, url, payload)
    return cut_lineage(
        rows.repartitionByRange(task_count(spark), "key", "number").sortWithinPartitions("key", "number", "kind")
        .mapInPandas(archive, "archive string, key string, number long, blocks long"), "archives")


class _Index:
    """Look-ups in the archives of one folder; holds one directory and one block at a time."""

    def __init__(self, archives: list[tuple[str, str, int]]) -> None:
        self.names = [a for a, *_ in archives]
        self.firsts = [(k.encode(), n) for _, k, n in archives]
        self.archive = self.block = None

    def find(self, key: str, number: int) -> Iterator[bytes]:
        wanted = (key.encode(), number)
        i = bisect_right(self.firsts, wanted) - 1
        if i < 0:
            return
        if self.archive != self.names[i]:
            self.archive, self.block = self.names[i], None
            self.directory = pickle.loads(B.get(f"{self.archive}.dir"))
            self.begins = [(k.encode(), n) for (k, n), _, _ in self.directory]
            self.index, self.records = B.Reader(f"{self.archive}.idx"), B.Reader(f"{self.archive}.warc.gz")
        b = bisect_right(self.begins, wanted) - 1
        if b < 0:
            return
        if self.block != b:
            data = zlib.decompress(self.index.read(*self.directory[b][1:]))
            split = [line.split("\t", 3) for line in data.decode().split("\n")]
            self.keys = [(k.encode(), int(n)) for n, _, _, k in split]
            self.places, self.block = [(int(o), int(s)) for _, o, s, _ in split], b
        at = bisect_right(self.keys, wanted) - 1
        first = at
        while first >= 0 and self.keys[first] == wanted:
            first -= 1
        for place in self.places[first + 1:at + 1]:
            yield gzip.decompress(self.records.read(*place))


def read(archives: DataFrame, wanted: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the captures ``wanted`` (page_id, url; repeated ones count once).

    ``archives`` is what ``write`` returned: one row per task of the writer. Captures that are not there give
    no rows. Digest and size of a response are those of the payload read, and must agree with its header.
    """
    spark = wanted.sparkSession
    B.bounded_batches(spark)
    # one short row per archive, and as many archives as shuffle partitions
    top = sorted((r["key"].encode(), r["number"], r["archive"], r["key"]) for r in archives.collect())
    top = [(a, k, n) for _, n, a, k in top]

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index(top)
        for f in frames:
            rows, size = [], 0
            for key, number in zip(f["key"], f["number"]):
                for data in index.find(key, number):
                    fields, http, body = parse(data)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(body).hexdigest() != digest
                                               or len(body) != int(http["Content-Length"])):
                        raise ValueError(f"record {fields['WARC-Record-ID']} does not agree with its digest")
                    rows.append((_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"),
                                 int(http["Content-Length"]), digest, kind, _id(fields.get("WARC-Refers-To")),
                                 *([body if kind == "response" else None] if payload else [])))
                    size += len(body)
                if size > 8 << 20:
                    yield _frame(rows, payload)
                    rows, size = [], 0
            yield _frame(rows, payload)

    keyed = _keyed(wanted.select(F.col("page_id").cast("long"), F.col("url").cast("string")))
    keyed = keyed.select("key", "number").distinct()
    return (keyed.repartitionByRange(task_count(spark), "key", "number").sortWithinPartitions("key", "number")
            .mapInPandas(look_up, RECORDS + ", payload binary" * payload))


def _frame(rows: list[tuple], payload: bool) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
