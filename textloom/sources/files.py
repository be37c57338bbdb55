"""Files in any store that pyarrow reaches: compressed lines, and flat token streams in parts with a manifest."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ordered import with_position

MANIFEST = "manifest.json"


def store_of(uri: str):
    """pyarrow's file system for a URI or local path, and the path in it; works in Python workers too."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def read_bytes(uri: str, begin: int = 0, size: int | None = None) -> bytes:
    fs, path = store_of(uri)
    with fs.open_input_file(path) as f:
        f.seek(begin)
        return f.read(size)


def write_bytes(uri: str, data: bytes) -> None:
    fs, path = store_of(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)


class Piece(InputPartition):
    def __init__(self, *parts):
        self.parts = parts


class CompressedLines(DataSource):
    """Rows (file, number, value) of the lines of zstandard files; a file is a partition, and is read as a stream."""

    @classmethod
    def name(cls) -> str:
        return "zst_lines"

    def schema(self) -> str:
        return "file string, number long, value string"

    def reader(self, schema):
        return CompressedLinesReader(self.options)


class CompressedLinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]

    def partitions(self):
        from pyarrow import fs as pafs

        fs, path = store_of(self.uri)
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return [Piece(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and f.path.endswith((".zst", ".zstd"))]

    def read(self, partition):
        import io

        import zstandard

        fs, _ = store_of(self.uri)
        (path,) = partition.parts
        with fs.open_input_stream(path, compression=None) as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as plain:
            for i, line in enumerate(io.TextIOWrapper(plain, encoding="utf-8", errors="replace")):
                yield path, i, line.rstrip("\n")


def compressed_json(spark: SparkSession, uri: str, schema: str) -> DataFrame:
    """Records of zstandard-compressed JSON lines; blank and broken lines are passed over."""
    spark.dataSource.register(CompressedLines)
    lines = spark.read.format("zst_lines").option("path", uri).load().where(F.trim("value") != "")
    parsed = lines.select("file", "number", F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._broken IS NULL").select("r.*", "file").drop("_broken")


def chunks(rows: DataFrame, length: int, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """seq, tokens: the stream of all documents' tokens in order of key, cut into rows of length + 1 that share their border tokens.

    As many rows as the stream holds whole: floor((n - 1) / length). A token's place follows from the lengths before its
    document, so nothing but the tokens of a row meet in a task.
    """
    counted = rows.select(F.col(key).alias("k"), F.col(tokens).alias("x")).withColumn("n", F.coalesce(F.size("x"), F.lit(0)).cast("long"))
    placed = with_position(counted, "k", total="n").where("n > 0")
    total = placed.agg(F.coalesce(F.floor((F.sum("n") - 1) / length), F.lit(0)).alias("rows"))
    # A document's part of each row that it touches; border tokens belong to two rows.
    first, last = F.greatest(F.floor((F.col("before") - 1) / length), F.lit(0)), F.floor((F.col("before") + F.col("n") - 1) / length)
    parts = placed.withColumn("seq", F.explode(F.sequence(first, last))).crossJoin(F.broadcast(total)).where("seq < rows")
    begin, end = F.greatest(F.col("before"), F.col("seq") * length), F.least(F.col("before") + F.col("n"), F.col("seq") * length + length + 1)
    cut = parts.withColumn("begin", begin).withColumn("end", end).where("end > begin")
    cut = cut.select("seq", "begin", F.slice("x", (F.col("begin") - F.col("before") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")).alias("x"))
    joined = cut.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("begin", "x"))).alias("parts"))
    return joined.select("seq", F.flatten(F.transform("parts", lambda p: p["x"])).alias("tokens"))


def sequences(source: DataFrame) -> DataFrame:
    """Rows of several sources as one: (source, row, tokens) get consecutive numbers in order of source, then row."""
    return with_position(source, "source", "row").withColumn("row", F.col("position")).drop("position")


def write_token_stream(rows: DataFrame, uri: str, key: str = "doc_id", tokens: str = "tokens") -> dict:
    """Documents' tokens in order of key as 16-bit files, with the documents' starts as 64-bit ones, in parts; returns the manifest.

    Each task writes the part of its range under a name of its own attempt, and only what a task returned enters the
    manifest, so a lost executor leaves an unnamed file. Starts are checked: the first is 0, they grow, and all lie inside
    the stream; so an empty document is an error, as is a token beyond 16 bits. The digests are over the parts' digests.
    """
    placed = with_position(rows.select(F.col(key).alias("k"), F.col(tokens).cast("array<int>").alias("x")).withColumn("n", F.coalesce(F.size("x"), F.lit(0)).cast("long")), "k", total="n")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_of(uri)
        fs.create_dir(root, recursive=True)
        name, out, starts, total, at = uuid.uuid4().hex, None, [], 0, None
        digest = hashlib.sha256()
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() > 0xFFFF):
                raise ValueError("a token needs more than 16 bits")
            if (batch.column("n").to_numpy() < 1).any():
                raise ValueError("a document without tokens")
            at = int(batch.column("before")[0].as_py()) if at is None and batch.num_rows else at
            starts.append(batch.column("before").to_numpy().astype("<i8"))
            data = flat.astype("<u2").tobytes()
            out = out or fs.open_output_stream(f"{root}/tokens-{name}.bin", compression=None)
            out.write(data)
            digest.update(data)
            total += len(flat)
        if out:
            out.close()
            every = np.concatenate(starts)
            with fs.open_output_stream(f"{root}/starts-{name}.bin", compression=None) as f:
                f.write(every.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, name, total, len(every), digest.hexdigest(), hashlib.sha256(every.tobytes()).hexdigest())], names=["at", "name", "n_tokens", "n_docs", "tokens_sha", "starts_sha"])

    ranged = placed.repartitionByRange("position").sortWithinPartitions("position").select("x", "n", "before")
    parts = sorted(tuple(r) for r in ranged.mapInArrow(write, "at long, name string, n_tokens long, n_docs long, tokens_sha string, starts_sha string").collect())
    ends = [0]
    for at, _, n, *_ in parts:
        if at != ends[-1]:
            raise ValueError("parts of the stream don't follow each other")
        ends.append(at + n)
    manifest = {"dtype": "uint16", "n_tokens": ends[-1], "n_docs": sum(p[3] for p in parts), "parts": [dict(zip(("at", "name", "n_tokens", "n_docs"), p, strict=False)) for p in parts]}
    manifest |= {f"{kind}_sha256": hashlib.sha256("".join(p[i] for p in parts).encode()).hexdigest() for kind, i in (("tokens", 4), ("starts", 5))}
    write_bytes(f"{uri}/{MANIFEST}", json.dumps(manifest, sort_keys=True).encode())
    return manifest


class TokenFiles(DataSource):
    """Rows (row, tokens) of length + 1 tokens from a flat file of 16-bit tokens, or from a stream's folder by its manifest.

    Options: path (several, split by commas, are read one after the other, and each one's remainder is dropped), length,
    rowsPerPartition.
    """

    @classmethod
    def name(cls) -> str:
        return "token_file"

    def schema(self) -> str:
        return "row long, tokens array<int>"

    def reader(self, schema):
        return TokenFileReader(self.options)


class TokenFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.length, self.rows = options["path"].split(","), int(options.get("length", "1024")), int(options.get("rowsPerPartition", "1024"))

    def parts_of(self, uri: str) -> list[tuple[str, int, int]]:
        """(file, first token, tokens) of a path."""
        from pyarrow import fs as pafs

        fs, path = store_of(uri)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.Directory:
            manifest = json.loads(read_bytes(f"{uri}/{MANIFEST}"))
            return [(f"{path}/tokens-{p['name']}.bin", p["at"], p["n_tokens"]) for p in manifest["parts"]]
        return [(path, 0, info.size // 2)]

    def partitions(self):
        out, row = [], 0
        for uri in self.paths:
            parts = self.parts_of(uri)
            n = max(0, (sum(p[2] for p in parts) - 1) // self.length)
            for a in range(0, n, self.rows):
                b = min(a + self.rows, n)
                near = [p for p in parts if p[1] <= b * self.length and p[1] + p[2] > a * self.length]
                out.append(Piece(uri, near, a, b, row))
            row += n
        return out or [Piece(self.paths[0], [], 0, 0, 0)]

    def read(self, partition):
        uri, parts, a, b, offset = partition.parts
        fs, _ = store_of(uri)
        for i in range(a, b):
            want, got = (i * self.length, (i + 1) * self.length + 1), []
            for path, at, n in parts:
                begin, end = max(want[0], at), min(want[1], at + n)
                if begin < end:
                    with fs.open_input_file(path) as f:
                        f.seek(2 * (begin - at))
                        got.append(np.frombuffer(f.read(2 * (end - begin)), "<u2"))
            yield offset + i, np.concatenate(got).astype(int).tolist()


def write_branch(packed: DataFrame, uri: str, settings: dict) -> dict:
    """A branch for training: sequences (seq, tokens, bounds, kind) in order of seq, with a manifest.

    Tokens of all sequences are one stream; bounds, the places in a sequence where documents begin (the first 0, growing,
    inside), and kinds stand beside it as Parquet in the same order. The manifest holds the counts, the settings and a
    digest of the sequences.
    """
    wrong = packed.where("bounds IS NULL OR size(bounds) = 0 OR bounds[0] <> 0 OR NOT array_sort(bounds) <=> bounds OR size(array_distinct(bounds)) < size(bounds) OR array_max(bounds) >= size(tokens)")
    if wrong.limit(1).count():
        raise ValueError("bounds must begin with 0, grow, and lie inside their sequence")
    stream = write_token_stream(packed, f"{uri}/tokens", "seq")
    packed.select("seq", "bounds", "kind").repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(f"{uri}/bounds")
    kinds = {str(r["kind"]): r["n"] for r in packed.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()}
    manifest = {"n_sequences": sum(kinds.values()), "n_tokens": stream["n_tokens"], "tokens_sha256": stream["tokens_sha256"], "kinds": kinds, "settings": settings}
    write_bytes(f"{uri}/branch.json", json.dumps(manifest, sort_keys=True).encode())
    return manifest
