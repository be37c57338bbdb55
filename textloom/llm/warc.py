"""WARC archives with a two-level capture index.

Writing: of records with equal payloads the one with the smallest page_id is a response, the others are revisits that
name it. Each task writes one archive of gzip members below the shared folder, under a name of its own attempt, and only
committed attempts reach the table of captures, so a lost executor leaves nothing but an unnamed file. Indexing: captures
are sorted by reversed-host URL key across the cluster, and each task writes its range as one index file of compressed
blocks with a sparse directory of the blocks' first keys at its end; the table of files holds one row a task. Reading: a
lookup searches the files' first keys, then the file's directory, reads one block by its range, and finds its capture;
records are then read by their ranges, in the order of the archives.

Defined results: a null html is an empty payload; equal payloads below 100 bytes are all responses; a null url has an
empty key; a null page_id is kept, and never named by a revisit unless all equal payloads have none, in which case all
are responses; rows that repeat a page_id are records each, with record ids of their own, and tie in the index by archive
and place; pages of any length are written whole; an empty table gives no archive and no rows; only page_id, url and html
are read, so other columns may have any name.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, file_system, shared_dir, written

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
#: Lines of an index block; bytes of an archive that one group of reads covers.
BLOCK_LINES, READ_SPAN = 256, 16 << 20
#: The date of all records, for archives that don't differ from run to run.
DATE = "2024-01-01T00:00:00Z"
CAPTURES = T.StructType([T.StructField(n, t) for n, t in (("key", T.StringType()), ("page_id", T.LongType()), ("file", T.StringType()), ("begin", T.LongType()), ("size", T.LongType()))])


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, in lower case, without scheme, user and default port."""
    try:
        u = urlsplit(url or "")
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url or ""
    labels = ",".join(reversed(host.split("."))) if host else ""
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return f"{labels}{f':{port}' if port and port not in (80, 443) else ''}){tail}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str = "") -> bytes:
    """One WARC record as a gzip member; a revisit has no payload, but its length and digest.

    The record's id follows from its archive and place, so it is unique; pages stand in fields of their own.
    """
    revisit = refers_to is not None
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += [f"X-Refers-To-Page: {refers_to}", f"WARC-Refers-To-Date: {DATE}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut")
    return fields, body


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Writes the archives below uri; the table of captures."""
    spark = pages.sparkSession
    bounded_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    long_ = F.octet_length("html") >= LEAST_REVISIT
    same = rows.where(long_).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same_digest"), "first")
    joined = rows.join(same, (F.col("digest") == F.col("same_digest")) & long_, "left").select("page_id", "url", "html", "digest", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))

    def run(batches):
        fs, root = file_system(uri)
        fs.create_dir(root, recursive=True)
        name, at, out = f"captures-{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                keys, begins, sizes = [], [], []
                for p, u, h, d, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = record(p, u, h.encode(), d, r, f"{name}:{at}")
                    out.write(member)
                    keys.append(url_key(u))
                    begins.append(at)
                    sizes.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0), pa.array([name] * len(keys), pa.string()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64())], names=CAPTURES.names)
        finally:
            if out:
                out.close()

    return written(joined.mapInArrow(run, CAPTURES), "captures")


#: What orders captures: the key, then page_id, then what tells repeated rows apart.
ORDER = ("key", "page_id", "file", "begin")


def write_index(captures: DataFrame, uri: str, files: int) -> DataFrame:
    """Sorts the captures into index files; the table of files: name, first entry, length of its directory."""

    def run(batches):
        fs, root = file_system(uri)
        fs.create_dir(root, recursive=True)
        name = f"index-{uuid.uuid4().hex}"
        held, directory, at, out, first = [], [], 0, None, None

        def put():
            nonlocal at
            data = zlib.compress("\n".join(map(json.dumps, held)).encode(), 6)
            directory.append((held[0][:2], at, len(data)))
            out.write(data)
            at += len(data)
            held.clear()

        try:
            for batch in batches:
                for key, page, file, begin, size in zip(*(batch.column(n).to_pylist() for n in ("key", "page_id", "file", "begin", "size")), strict=True):
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                    held.append((key, -1 if page is None else page, page is None, file, begin, size))
                    first = first or held[0]
                    if len(held) == BLOCK_LINES:
                        put()
            if held:
                put()
            if out:
                tail = zlib.compress(json.dumps(directory).encode())
                out.write(tail + struct.pack("<q", len(tail)))
        finally:
            if out:
                out.close()
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([at + len(tail) + 8], pa.int64())], names=["name", "key", "page_id", "size"])

    # Nulls sort first, as -1 does among the ids.
    dealt = captures.repartitionByRange(files, *ORDER).sortWithinPartitions(*ORDER)
    return written(dealt.mapInArrow(run, "name string, key string, page_id long, size long"), "index-files")


@lru_cache(maxsize=4)
def top_level(uri: str, table: tuple) -> tuple[list, list]:
    rows = sorted((key, page, name, size) for name, key, page, size in table)
    return [r[:2] for r in rows], [r[2:] for r in rows]


@lru_cache(maxsize=64)
def directory_of(uri: str, name: str, size: int) -> tuple[list, list]:
    """The sparse directory of an index file, by two range reads at its end."""
    fs, root = file_system(uri)
    with fs.open_input_file(f"{root}/{name}") as f:
        f.seek(size - 8)
        (n,) = struct.unpack("<q", f.read(8))
        f.seek(size - 8 - n)
        rows = json.loads(zlib.decompress(f.read(n)))
    return [tuple(r[0]) for r in rows], [(r[1], r[2]) for r in rows]


@lru_cache(maxsize=16)
def block_of(uri: str, name: str, at: int, size: int) -> list[tuple]:
    fs, root = file_system(uri)
    with fs.open_input_file(f"{root}/{name}") as f:
        f.seek(at)
        return [tuple(json.loads(x)) for x in zlib.decompress(f.read(size)).decode().split("\n")]


def lookup(uri: str, table: tuple, key: str, page_id: int | None) -> list[tuple]:
    """The captures (file, begin, size) of a URL key and page: files by first key, block by directory, line by search."""
    wanted = (key, -1 if page_id is None else page_id)
    firsts, files = top_level(uri, table)
    # Equal captures may begin in the file, and the block, before the first that starts with them.
    out = []
    for i in range(max(0, bisect.bisect_left(firsts, wanted) - 1), bisect.bisect_right(firsts, wanted)):
        heads, ranges = directory_of(uri, *files[i])
        for b in range(max(0, bisect.bisect_left(heads, wanted) - 1), bisect.bisect_right(heads, wanted)):
            lines = block_of(uri, files[i][0], *ranges[b])
            at = bisect.bisect_left(lines, wanted, key=lambda x: x[:2])
            while at < len(lines) and lines[at][:2] == wanted:
                if lines[at][2] == (page_id is None):
                    out.append(lines[at][3:])
                at += 1
    return out


def locate(pages: DataFrame, uri: str, files: list[tuple], parts: int) -> DataFrame:
    """Looks every page up in the index: file, begin, size of its captures. Lookups are sorted, so a task reads near blocks."""
    table = tuple(files)

    def run(batches):
        for batch in batches:
            found = [x for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in lookup(uri, table, k, p)]
            f, b, s = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(b, pa.int64()), pa.array(s, pa.int64())], names=["file", "begin", "size"])

    keys = pages.select("key", "page_id").distinct().repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return keys.mapInArrow(run, "file string, begin long, size long")


OUT = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("url", T.StringType()))])


def page_of(number: str) -> int | None:
    return int(number) if number else None


def read_records(found: DataFrame, uri: str, parts: int) -> DataFrame:
    """Reads the captures by their ranges and checks a response's payload against its digest."""

    def run(batches):
        fs, root = file_system(uri)
        name, f = None, None
        for batch in batches:
            rows = []
            for file, begin, size in zip(*(batch.column(n).to_pylist() for n in ("file", "begin", "size")), strict=True):
                if file != name:
                    if f:
                        f.close()
                    name, f = file, fs.open_input_file(f"{root}/{file}")
                f.seek(begin)
                head, body = parse(f.read(size))
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"digest of {file} at {begin}")
                rows.append((page_of(head["X-Page-ID"]), len(body) if head["WARC-Type"] == "response" else int(head["X-Payload-Length"]), digest, head["WARC-Type"], page_of(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None, head["WARC-Target-URI"]))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=OUT.names)
        if f:
            f.close()

    span = F.floor(F.col("begin") / READ_SPAN)
    return found.repartition(parts, "file", span).sortWithinPartitions("file", "begin").mapInArrow(run, OUT)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes archives and index, looks every page up, and reads its record back."""
    spark: SparkSession = pages.sparkSession
    base = shared_dir(spark, "warc")
    captures = write_archives(pages, f"{base}/archives")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One row a task, so the table of files is bounded by the number of tasks.
    files = [tuple(r) for r in write_index(captures, f"{base}/index", parts).select("name", "key", "page_id", "size").collect()]
    return read_records(locate(captures, f"{base}/index", files, parts), f"{base}/archives", parts)
