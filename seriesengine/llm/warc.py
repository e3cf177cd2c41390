"""WARC archives with a two-level capture index, written to and read from the shared folder."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesengine.llm.common import utf8_bytes
from seriesengine.session import materialize, shared_dir

#: Payloads below this size are always stored.
LEAST_SHARED = 1000
#: Bytes after which an archive is closed and the next one begun.
ARCHIVE_BYTES = 64_000_000
#: Captures in a compressed block of the index.
BLOCK_LINES = 200


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder given as a path or as a URI (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def surt(url: str | None) -> str:
    """Sort key of a URL: host parts reversed, then path and query; white space is escaped.

    Null is the empty key. A text without a host is a key of its own, after ``)``.
    """
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return ")" + quote(url, safe="/?&=:%,;@")
    if not host:
        return ")" + quote(url, safe="/?&=:%,;@")
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    usual = {"http": 80, "https": 443}.get(parts.scheme)
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != usual else "")
    return quote(f"{place}){tail}", safe="/?&=:%,;@)(!*'+$[]~#")


def _record(row: dict) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, which states the payload's size."""
    payload = row["payload"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    block = head + (payload if row["record_type"] == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{_name(row['page_id'])}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {quote(row['url'] or '', safe=':/?&=%,;@#+$!*()[]~')}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
    ]
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{_name(row['refers_to'])}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page: int | None) -> str:
    return "none" if page is None else str(page)


def _page(text: str | None) -> int | None:
    name = (text or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if name == "none" else int(name)


def parse_record(data: bytes) -> dict:
    """The head of one record as a dict, with ``payload`` and ``size`` of the full payload."""
    head, block = data.split(b"\r\n\r\n", 1)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = dict(line.split(": ", 1) for line in lines)
    block = block[: int(out["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return out | {"payload": payload, "size": size}


def plan_records(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, size, digest, record_type, refers_to) for every row.

    Of equal payloads of LEAST_SHARED bytes or more (same SHA-1 and size) the row with the
    largest key is the response and the others revisit it; rows that repeat that key are
    responses as well. Null payloads are empty, and null keys can be revisits only. Groups are
    counted before they move; a very large group is split by adaptive execution.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), text.alias("payload"),
        utf8_bytes(text).alias("size"), F.sha1(text.cast("binary")).alias("digest"),
    )
    large = rows.filter(F.col("size") >= LEAST_SHARED)
    shared = large.groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    out = rows.join(shared.filter("n > 1").drop("n"), ["digest", "size"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return out.select(
        *rows.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records as gzip members into archives of ``folder``; returns their captures
    (surt, file, offset, length). Files of a failed task are left without captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, path = store(folder)
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = disk.open_output_stream(f"{path}/{name}", compression=None)
                row["payload"] = row["payload"].encode("utf-8", "surrogatepass")
                member = gzip.compress(_record(row), mtime=0)
                out.write(member)
                found.append((surt(row["url"]), name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("surt", "file", "offset", "length"), f, strict=True)) for f in found],
                pa.schema([("surt", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]),
            )
        if out is not None:
            out.close()

    return materialize(records.mapInArrow(run, "surt string, file string, offset long, length long"))


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures by key into index shards; returns one row (shard, first, last) for each.

    A shard is a file of compressed blocks of BLOCK_LINES lines, and beside it a sparse directory
    with the first key and the byte range of each block. Keys that many captures share may run
    over several blocks and shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, path = store(folder)
        name, out, lines, directory, at, last = uuid.uuid4().hex, None, [], [], 0, None

        def block() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode())
            out.write(data)
            directory.append([lines[0].split(" ", 1)[0], at, len(data)])
            at, lines = at + len(data), []

        for batch in batches:
            for row in batch.to_pylist():
                out = out or disk.open_output_stream(f"{path}/{name}.blocks")
                last = row["surt"]
                lines.append(f"{last} {json.dumps([row['file'], row['offset'], row['length']])}")
                if len(lines) == BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            out.close()
            with disk.open_output_stream(f"{path}/{name}.directory") as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_pylist([{"shard": name, "first": directory[0][0], "last": last}])

    order = ["surt", "file", "offset"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(run, "shard string, first string, last string"))


class Shard:
    """Look-ups in one index shard: binary search in its directory, then ranges of its blocks."""

    def __init__(self, folder: str, name: str) -> None:
        disk, path = store(folder)
        with disk.open_input_stream(f"{path}/{name}.directory") as f:
            self.directory = json.loads(f.read())
        self.firsts = [d[0] for d in self.directory]
        self.file = disk.open_input_file(f"{path}/{name}.blocks")
        self.held: tuple[int, list[list[str]]] = (-1, [])

    def block(self, i: int) -> list[list[str]]:
        if self.held[0] != i:
            _, at, size = self.directory[i]
            self.file.seek(at)
            self.held = (i, [x.split(" ", 1) for x in zlib.decompress(self.file.read(size)).decode().split("\n")])
        return self.held[1]

    def captures(self, key: str) -> Iterator[list]:
        """[file, offset, length] of every capture of a key."""
        i = max(bisect_left(self.firsts, key) - 1, 0)  # the key may begin inside the block before
        while i < len(self.firsts) and self.firsts[i] <= key:
            lines = self.block(i)
            a = bisect_left(lines, key, key=lambda x: x[0])
            b = bisect_right(lines, key, key=lambda x: x[0])
            yield from (json.loads(x[1]) for x in lines[a:b])
            i += 1


def find_captures(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """(file, offset, length) of all captures of the distinct ``surt`` of ``keys``.

    The shards' first and last keys, a row for each index file, are the upper level of the
    search; they decide which shards a key is looked up in.
    """
    bounds = sorted((r["first"], r["last"], r["shard"]) for r in shards.collect())  # one row a file
    table = keys.sparkSession.sparkContext.broadcast(bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [b[0] for b in table.value], [b[1] for b in table.value]
        for batch in batches:
            found = [
                {"shard": table.value[i][2], "surt": k}
                for k in batch.column(0).to_pylist()
                for i in range(bisect_left(lasts, k), bisect_right(firsts, k))
            ]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("shard", pa.string()), ("surt", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    name, shard = row["shard"], Shard(folder, row["shard"])
                found += [dict(zip(("file", "offset", "length"), c, strict=True)) for c in shard.captures(row["surt"])]
            yield pa.RecordBatch.from_pylist(
                found, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
            )

    placed = keys.select("surt").distinct().mapInArrow(place, "shard string, surt string")
    near = placed.repartitionByRange("shard", "surt").sortWithinPartitions("shard", "surt")
    return near.mapInArrow(search, "file string, offset long, length long")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records at the captures' byte ranges, in READ's columns.

    A response's digest is computed from its payload and must equal the stated one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, path = store(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, file = row["file"], disk.open_input_file(f"{path}/{row['file']}")
                file.seek(row["offset"])
                r = parse_record(gzip.decompress(file.read(row["length"])))
                digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                if r["WARC-Type"] == "response" and (
                    hashlib.sha1(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["size"]
                ):
                    raise ValueError(f"damaged record in {name} at {row['offset']}")
                refers = _page(r["WARC-Refers-To"]) if r["WARC-Type"] == "revisit" else None
                out.append((_page(r["WARC-Record-ID"]), r["size"], digest, r["WARC-Type"], refers))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    near = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, READ)


def new_folder(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    disk, path = store(folder)
    disk.create_dir(path, recursive=True)
    return folder


def archive_pages(
    pages: DataFrame, folder: str | None = None, *, key: str = "page_id", url: str = "url", payload: str = "html"
) -> tuple[DataFrame, DataFrame, str]:
    """Writes every row of ``pages`` as a WARC record and indexes the archives.

    Returns the captures, the index shards and the folder, which all executors must reach. An
    empty table gives no archive and an empty index.
    """
    folder = folder or new_folder(pages.sparkSession)
    captures = write_archives(plan_records(pages, key=key, url=url, payload=payload), folder)
    return captures, write_index(captures, folder), folder
