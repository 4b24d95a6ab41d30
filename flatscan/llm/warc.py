"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by key and payload digest and cut into key ranges, the
shards; range bounds come from a sample of keys chosen by their hashes, so they
depend on the rows alone. Shards and sampled keys are bounded in number: beyond
MAX_SHARDS shards of SHARD_BYTES, shards grow with the input. One task writes a
shard, a file at a time; a file is closed once its compressed size reaches a
limit. Headers, record ids and digests are made from the row, never copied. A
file is written in a folder of temporary names and moved to its own once it is
whole, and the archive counts as written once its manifest has its name; that
folder goes then, with what lost tasks left there. A task that is run again
writes the same bytes to the same names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, pieces_for

SHARD_BYTES = 16 << 20
ROLL_BYTES = 4 << 20
MAX_SHARDS = 16_384
#: Keys of some 60 bytes that reach the driver to find the bounds; the bounds go to each task.
MAX_SAMPLE = 1 << 18
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest"
UNNAMED = "_unnamed"
MANIFEST_SCHEMA = "shard int, seq int, name string, records bigint, bytes bigint, sha256 string"
RECORD_SCHEMA = "key bigint, uri string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    """The same for a record and for those that refer to it."""
    name = hashlib.sha1(f"{'' if key is None else key}/{digest}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def _uri(url: str | None) -> str:
    """url with white space and control characters as percent escapes; a header is one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Record-Key", "" if key is None else str(key)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Key", str(refers_to))]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return _record(headers, http + (payload if refers_to is None else b""))


def file_record(name: str) -> bytes:
    block = f"software: flatscan\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    rid = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name.encode()).digest()[:16], version=5)}>"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any file system that pyarrow knows, by the URI; plain paths are local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


class ShardWriter:
    """Files of one shard, closed by compressed size and named by renames."""

    def __init__(self, uri: str, shard: int, roll: int):
        self.fs, self.dir = filesystem(uri)
        self.shard, self.roll, self.seq, self.parts, self.size, self.records = shard, roll, 0, [], 0, 0

    def name(self) -> str:
        return f"part-{self.shard:06d}-{self.seq:06d}.warc.gz"

    def add(self, record: bytes) -> Iterator[tuple]:
        if not self.parts:
            self.parts, self.records = [file_record(self.name())], 0
            self.size = len(self.parts[0])
        self.parts.append(record)
        self.size += len(record)
        self.records += 1
        if self.size >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if not self.parts:
            return
        data, name = b"".join(self.parts), self.name()
        temporary, final = f"{self.dir}/{UNNAMED}/{name}.{uuid.uuid4().hex}", f"{self.dir}/{name}"
        with self.fs.open_output_stream(temporary) as f:
            f.write(data)
        try:
            self.fs.move(temporary, final)
        except OSError:
            # not every file system replaces a file that an earlier attempt of the task has named
            if self.fs.get_file_info(final).type != pafs.FileType.File:
                raise
            self.fs.delete_file(final)
            self.fs.move(temporary, final)
        yield self.shard, self.seq, name, self.records, len(data), hashlib.sha256(data).hexdigest()
        self.seq, self.parts = self.seq + 1, []


def _bounds(keyed: DataFrame, rows: int, shards: int) -> list[tuple]:
    """The first (key, digest) of each shard but the first, from up to 64 keys a shard and MAX_SAMPLE or so in all."""
    if shards < 2:
        return []
    step = max(1, rows // min(shards * 64, MAX_SAMPLE))
    some = keyed.where(F.pmod(F.xxhash64("key", "sha"), F.lit(step)) == 0).select("key", "sha").distinct().collect()
    some = sorted((r["key"] is not None, r["key"] or 0, r["sha"]) for r in some)
    return [some[len(some) * i // shards] for i in range(1, shards)] if some else []


def write_archive(
    pages: DataFrame,
    uri: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Writes a record per row of pages to the empty or new folder ``uri``; returns the manifest.

    ``key`` is cast to a 64-bit number; text that is none fails as Spark's cast does.
    Of records with equal payloads of ``min_bytes`` or more, that with the
    largest key is a response and the others are revisits that refer to it;
    repeated rows with the largest key are all responses. A null payload is
    empty. A row without key is a revisit where its payload has a record with
    one, else a response. A null URL is about:blank. A very long payload is one
    record, in memory once. Extra columns are not written, whatever their names.
    An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    hadoop = path(uri).getFileSystem(spark._jsc.hadoopConfiguration())
    if hadoop.exists(path(f"{uri}/{MANIFEST}")):
        raise FileExistsError(f"{uri} has a manifest already")
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    src = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("payload")).withColumn("sha", F.sha1("payload"))
    total = src.agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes")).head()
    shards = min(MAX_SHARDS, pieces_for(total["bytes"] or 0, shard_bytes))
    keyed = src.where(F.octet_length("payload") >= min_bytes).select("key", "sha")
    newest = checkpoint(keyed.groupBy("sha").agg(F.max("key").alias("newest"), F.count("*").alias("n")).where("n > 1 and newest is not null").drop("n"))
    revisits = keyed.join(newest, "sha").where("key is null or key < newest").select("key", "sha", F.col("newest").alias("refers_to")).distinct()
    bounds = _bounds(src, total["n"], shards)
    marks = revisits.select("key", "sha", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    rows = src.select("key", "sha", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "payload").unionByName(marks)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(bounds, (k is not None, k or 0, s)) for k, s in zip(b["key"].to_pylist(), b["sha"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "shard"])

    dealt = rows.mapInArrow(assign, "key bigint, sha string, kind int, refers_to bigint, url string, payload binary, shard int")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "sha", "kind", "url")
    fs, folder = filesystem(uri)
    fs.create_dir(f"{folder}/{UNNAMED}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, refers, known = None, None, None
        done: list[tuple] = []
        for b in batches:
            for r in b.to_pylist():
                if writer is None or writer.shard != r["shard"]:
                    done += writer.close() if writer else ()
                    writer = ShardWriter(uri, r["shard"], roll_bytes)
                if r["kind"] == 0:
                    known, refers = (r["key"], r["sha"]), r["refers_to"]
                    continue
                done += writer.add(page_record(r["key"], r["url"], r["payload"], refers if known == (r["key"], r["sha"]) else None))
        done += writer.close() if writer else ()
        columns = list(zip(*done, strict=True)) or [[]] * 6
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "seq", "name", "records", "bytes", "sha256"])

    # the manifest is written beside its place and gets its name in one step
    temporary = f"{uri}/_temporary-{uuid.uuid4().hex}"
    dealt.mapInArrow(write, MANIFEST_SCHEMA).write.parquet(temporary)
    if hadoop.exists(path(f"{uri}/{MANIFEST}")) or not hadoop.rename(path(temporary), path(f"{uri}/{MANIFEST}")):
        raise FileExistsError(f"{uri} has a manifest already")
    fs.delete_dir(f"{folder}/{UNNAMED}")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{uri}/{MANIFEST}")


def _headers(f: BinaryIO) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := f.readline()) not in (b"\r\n", b""):
        k, _, v = line.decode().rstrip("\r\n").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def parse(f: BinaryIO) -> Iterator[tuple[Any, ...]]:
    """The page records of a file, as RECORD_SCHEMA has them; digests are checked."""
    while version := f.readline():
        if version in (b"\r\n", b"\n"):
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record starts at {version[:40]!r}")
        h = _headers(f)
        block = f.read(int(h["content-length"]))
        if f"sha1:{base32_sha1(block)}" != h["warc-block-digest"]:
            raise ValueError(f"{h['warc-record-id']}: its block has another digest")
        if h["warc-type"] == "warcinfo":
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", head)[1])
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        whole = h["warc-type"] == "response"
        if whole and (base32_sha1(payload) != digest or len(payload) != size):
            raise ValueError(f"{h['warc-record-id']}: its payload has another digest or length")
        number = lambda k: int(h[k]) if h.get(k) else None
        yield number("x-record-key"), h["warc-target-uri"], h["warc-type"], number("x-refers-to-key"), payload if whole else None, size, digest


def read_archive(spark: SparkSession, uri: str, partitions: int | None = None) -> DataFrame:
    """The records of an archive, from the files that its manifest names."""
    files = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{uri}/{MANIFEST}")
    if partitions is None:
        partitions = max(1, min(files.count(), 100_000))
    files = files.select("name", "sha256").repartition(partitions, "name")
    schema = pa.schema([("key", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(uri)
        for b in batches:
            for name in b["name"].to_pylist():
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    held, size = [], 0
                    for record in parse(f):
                        held.append(record)
                        size += len(record[4] or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)

    return files.mapInArrow(run, RECORD_SCHEMA)
