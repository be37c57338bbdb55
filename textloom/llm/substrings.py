"""Repeated passages: windows of words that an earlier document has too, found through count-min sketches.

First pass: each partition counts its windows, each once a document, in the cells of a count-min sketch of two rows; a
partition's sketch travels as compressed lists of cells in shards, which one task each merges by addition. As only
estimates of two or more matter, a merged shard keeps a bit for each cell. Estimates never fall below the true count, so
no repeated window is lost. Second pass: only windows whose estimate is two or more in both rows are grouped, by 128 hash
bits under multipliers that each run draws anew: first within a task, where all but the smallest doc_id's are known to be
repeated at once, then between tasks, where each sends the smallest one alone. So a passage in a third of all documents
is as many rows as there are tasks and no more. Windows travel as compressed parcels, one a task and range of hashes;
ranges are narrow enough that a task groups one at a time, and so are those of documents, where lists of positions meet.
The words that windows of later documents cover are removed. Sketches have about four cells a word
up to a fixed bound, beyond which more windows pass to the exact step, and results stay the same.

Defined results: null is a text without words; a text of fewer than 13 words loses none; a document without doc_id loses
none and takes none; rows that repeat one doc_id don't count against each other, and each keeps its row; windows of equal
words tie by doc_id alone; whole texts are taken; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, file_system, make_dir, release, remove_dir, shared_dir, text_slices, written

WINDOW = 13
ROWS = 2
#: Cells of a sketch row: a power of two, about CELLS_PER_WORD for each word of the input, between these. The larger bound
#: (1 GB of bits a row) holds where workers can map the shared folder's files, the smaller (64 MB) where they must read them.
CELLS_PER_WORD, LEAST_BITS, MOST_BITS, MOST_HELD_BITS = 4, 16, 33, 29
#: Cells of a shard, which one task merges.
SHARD_BITS = 23
#: Windows that a task takes together in the first pass; half as many doubtful ones in the second.
FLUSH = 2_000_000
#: Words of the input for each bucket of windows, which a task groups at once.
BUCKET_WORDS = 1 << 19
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


@lru_cache(maxsize=2)
def lanes_of(seed: int) -> tuple:
    """Multipliers for bytes, places in a word and places in a window, of two independent hashes."""
    return tuple((randoms(seed + 6 * k + 1, 256), randoms(seed + 6 * k + 3, 1024), randoms(seed + 6 * k + 5, WINDOW)) for k in range(2))


def word_bounds(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, the first and last byte's places of each word, and each word's text."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    inside = ~BLANK[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    limits = np.cumsum([len(b) + 1 for b in raw])
    return data, starts, ends, np.searchsorted(limits, starts, "right")


def window_hashes(texts: list[str | None], seed: int, lanes: int = 2) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each window of WINDOW words its hashes, its text, and the number of its first word within the text."""
    data, starts, ends, owner = word_bounds(texts)
    n = len(starts) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return [none.astype(np.uint64)] * lanes, none, none
    valid = np.flatnonzero(owner[: n] == owner[WINDOW - 1 :])
    sizes = ends - starts
    heads = np.cumsum(sizes) - sizes
    within = np.arange(sizes.sum()) - np.repeat(heads, sizes)
    letters = data[np.flatnonzero(~BLANK[data])]
    out = []
    for bytes_, places, words in lanes_of(seed)[:lanes]:
        coefficient = places[within & 1023]
        if (far := within > 1023).any():
            coefficient = np.where(far, coefficient * (2 * (within >> 10).astype(np.uint64) + np.uint64(1)), coefficient)
        word = mixed(np.add.reduceat(bytes_[letters] * coefficient, heads) + sizes.astype(np.uint64))
        total = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            total += word[k : k + n] * words[k]
        out.append(mixed(total[valid]))
    first = np.searchsorted(owner, np.arange(len(texts)))
    return out, owner[valid], valid - first[owner[valid]]


def cells_of(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The window's cell in each row of the sketch."""
    return [(h >> np.uint64(64 - bits)), (mixed(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits))]


def sketch_parts(hashes: list[np.ndarray], bits: int) -> list[tuple[int, bytes, bytes]]:
    """A partition's sketch as (row and shard, cells with one window, cells with more), offsets as compressed steps."""
    every = np.concatenate(hashes)
    pack = zstandard.ZstdCompressor(level=1).compress
    width, shards = 1 << min(bits, SHARD_BITS), shards_of(bits)
    out = []
    for row, cells in enumerate(cells_of(every, bits)):
        cells = np.sort(cells)
        fresh = np.concatenate([[True], cells[1:] != cells[:-1]])
        heads = np.flatnonzero(fresh)
        many = np.diff(np.append(heads, len(cells))) > 1
        cells = cells[heads]
        cuts = np.searchsorted(cells, np.arange(shards + 1, dtype=np.uint64) * np.uint64(width))
        for s in range(shards):
            part, more = (cells[cuts[s] : cuts[s + 1]] - np.uint64(s * width)).astype(np.uint32), many[cuts[s] : cuts[s + 1]]
            if len(part):
                out.append((row * shards + s, pack(steps(part[~more])), pack(steps(part[more]))))
    return out


def shards_of(bits: int) -> int:
    return 1 << max(0, bits - SHARD_BITS)


def steps(sorted_cells: np.ndarray) -> bytes:
    """Differences in 16 bits where all fit, else in 32; the first byte tells."""
    d = np.diff(sorted_cells, prepend=np.uint32(0))
    return b"2" + d.astype("<u2").tobytes() if not len(d) or d.max() < 65536 else b"4" + d.astype("<u4").tobytes()


def unstepped(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.cumsum(np.frombuffer(raw[1:], "<u2" if raw[:1] == b"2" else "<u4"), dtype=np.int64)


def shard_name(at: int) -> str:
    return f"shard-{at:04d}"


def merge_shards(batches, uri: str, bits: int):
    """From rows (at, once, more) sorted by shard: sums the partitions' sketches, and writes a bit for each cell of two or more."""
    fs, root = file_system(uri)
    width = 1 << min(bits, SHARD_BITS)
    current, once, twice = None, None, None

    def put():
        bitmap = np.packbits(twice).tobytes()
        name = f"{root}/{shard_name(current)}"
        with fs.open_output_stream(tmp := f"{name}.{uuid.uuid4().hex}.tmp") as f:
            f.write(bitmap)
        fs.move(tmp, name)  # whole or not at all, whichever attempt comes last
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([int(twice.sum())], pa.int64())], names=["at", "cells"])

    for batch in batches:
        for at, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != current:
                if current is not None:
                    yield put()
                current, once, twice = at, np.zeros(width, bool), np.zeros(width, bool)
            cells = unstepped(a)
            twice[cells[once[cells]]] = True
            once[cells] = True
            cells = unstepped(b)
            once[cells] = twice[cells] = True
    if current is not None:
        yield put()


@lru_cache(maxsize=1)
def merged(uri: str, bits: int) -> list[list[np.ndarray | None]]:
    """The shards' bits of both rows, mapped where the folder's files can be; a shard that no window fell into has no file."""
    from pyarrow import fs as pafs

    fs, root = file_system(uri)
    out: list[list[np.ndarray | None]] = []
    for row in range(ROWS):
        out.append([])
        for s in range(shards_of(bits)):
            name = f"{root}/{shard_name(row * shards_of(bits) + s)}"
            if fs.get_file_info(name).type != pafs.FileType.File:
                out[-1].append(None)
            elif mappable(uri):
                out[-1].append(np.memmap(name, np.uint8, "r"))
            else:
                with fs.open_input_stream(name) as f:
                    out[-1].append(np.frombuffer(f.read(), np.uint8))
    return out


def mappable(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file")


def estimated_repeated(h: np.ndarray, uri: str, bits: int) -> np.ndarray:
    """Places of the windows whose estimate is two or more, in order."""
    alive = np.arange(len(h))
    shard_bits = np.uint64(min(bits, SHARD_BITS))
    for tables, cells in zip(merged(uri, bits), cells_of(h, bits), strict=True):
        c = cells[alive]
        shard = (c >> shard_bits).astype(np.uint16)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(len(tables) + 1))
        hit = np.zeros(len(alive), bool)
        for s, bitmap in enumerate(tables):
            if bitmap is not None and cuts[s] < cuts[s + 1]:
                at = order[cuts[s] : cuts[s + 1]]
                inner = c[at] & ((np.uint64(1) << shard_bits) - np.uint64(1))
                hit[at] = (bitmap[(inner >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (inner & np.uint64(7))).astype(np.uint8)) & 1 == 1
        alive = alive[hit]
    return alive


LISTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
#: What travels: rows of one bucket, column after column. Doubtful windows are (h, g, doc_id, mark, position), repeated ones the last three.
PARCEL = "bucket long, parcel binary"
WINDOW_KINDS, REPEAT_KINDS = ("<i8", "<i8", "<i8", "<i8", "<i4"), ("<i8", "<i8", "<i4")


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before; the first does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def parcels(bucket: np.ndarray, columns: list[np.ndarray], kinds: tuple[str, ...]):
    """Rows of each bucket in one compressed parcel, in the order they come in, in which neighbours share a document."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [np.ascontiguousarray(c[order], k) for c, k in zip(columns, kinds, strict=True)]
    cuts = np.append(np.flatnonzero(changes(bucket)), len(bucket)).tolist()
    pack = zstandard.ZstdCompressor(level=1).compress
    for k in range(0, len(cuts) - 1, 256):
        some = cuts[k : k + 257]
        raw = [b"".join([c[i:j].tobytes() for c in columns]) for i, j in zip(some, some[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[some[:-1]], pa.int64()), pa.array([b"z" + pack(x) if len(x) > 200 else b"r" + x for x in raw], pa.binary())], names=["bucket", "parcel"])


def unpacked(parcel: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(parcel[1:]) if parcel[:1] == b"z" else parcel[1:]
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * size
    return out


def whole_buckets(batches, passed: int | None = None):
    """From rows sorted by bucket: each bucket and its parcels; those from the bucket `passed` on go out as they are, as batches."""
    current, held = None, []
    for batch in batches:
        if passed is not None:
            later = pc.greater_equal(batch.column(0), passed)
            if pc.any(later).as_py():
                yield batch.filter(later), None
                batch = batch.filter(pc.invert(later))
        for bucket, parcel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != current and held:
                yield current, held
                held = []
            current = bucket
            held.append(parcel)
    if held:
        yield current, held


class Buckets:
    """So many buckets of windows by hash, and after them as many of documents; a bucket holds about BUCKET_WORDS windows at most."""

    def __init__(self, words: float):
        self.n = max(1, round(words / BUCKET_WORDS))

    def of(self, h: np.ndarray) -> np.ndarray:
        return ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)

    def windows(self, h, g, doc, mark, position):
        return parcels(self.of(h), [h, g, doc, mark, position], WINDOW_KINDS)

    def repeats(self, doc: np.ndarray, mark: np.ndarray, position: np.ndarray):
        """Each repeated window once, by document."""
        order = np.lexsort((position, mark, doc))
        doc, mark, position = doc[order], mark[order], position[order]
        fresh = changes(doc, mark, position)
        doc, mark, position = doc[fresh], mark[fresh], position[fresh]
        return parcels(self.n + self.of(mixed(doc.view(np.uint64) ^ mixed(mark.view(np.uint64)))), [doc, mark, position], REPEAT_KINDS)


def later_in_group(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another row of equal h and g has a smaller doc."""
    order = np.lexsort((doc, g, h))
    heads = np.flatnonzero(changes(h[order], g[order]))
    out = np.zeros(len(h), bool)
    out[order] = doc[order] > np.repeat(doc[order[heads]], np.diff(np.append(heads, len(h))))
    return out


def sent_off(rows: tuple[np.ndarray, ...], buckets: Buckets):
    """Groups a task's doubtful windows: those of a group's smallest doc_id go to the windows' bucket, the others are repeated, and go to their document's."""
    later = later_in_group(*rows[:3])
    yield from buckets.windows(*(c[~later] for c in rows))
    if later.any():
        yield from buckets.repeats(*(c[later] for c in rows[2:]))


def between_tasks(batches, buckets: Buckets):
    """Groups the windows of each bucket; what is repeated goes to its document's bucket."""
    for bucket, held in whole_buckets(batches, buckets.n):
        if held is None:
            yield bucket
            continue
        rows = [np.concatenate(c) for c in zip(*(unpacked(p, WINDOW_KINDS) for p in held), strict=True)]
        later = later_in_group(*rows[:3])
        if later.any():
            yield from buckets.repeats(*(c[later] for c in rows[2:]))


def by_document(batches):
    """One row for each document and text of a bucket, with its positions."""
    for _, held in whole_buckets(batches):
        doc, mark, position = (np.concatenate(c) for c in zip(*(unpacked(p, REPEAT_KINDS) for p in held), strict=True))
        order = np.lexsort((position, mark, doc))
        doc, mark, position = doc[order], mark[order], position[order]
        fresh = changes(doc, mark, position)
        doc, mark, position = doc[fresh], mark[fresh], position[fresh]
        heads = np.flatnonzero(changes(doc, mark))
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(doc)), pa.int32()), pa.array(position, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(doc[heads], pa.int64()), pa.array(mark[heads], pa.int64()), lists], names=LISTED.names)


def repeated_positions(df: DataFrame, seed: int | None = None) -> DataFrame:
    """doc_id, mark (hash of the text), positions: numbers of the first words of windows that a smaller doc_id has too."""
    spark = df.sparkSession
    bounded_batches(spark)
    seed = secrets.randbits(60) if seed is None else seed
    docs = df.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    uri = shared_dir(spark, "sketch")
    bits = int(min(MOST_BITS if mappable(uri) else MOST_HELD_BITS, max(LEAST_BITS, round(np.log2(max(1, chars / 6 * CELLS_PER_WORD))))))
    make_dir(spark, uri)
    buckets = Buckets(chars / 6)

    def count(batches):
        held, total = [], 0

        def sent():
            at, once, more = zip(*sketch_parts(held, bits), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["at", "once", "more"])

        for part in text_slices(batches):
            (h,), owner, _ = window_hashes(part.column("text").to_pylist(), seed, 1)
            # A window counts once a document.
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            h = h[changes(h, owner)]
            held.append(h)
            total += len(h)
            if total > FLUSH:
                yield sent()
                held, total = [], 0
        if total:
            yield sent()

    parts = docs.select("text").mapInArrow(count, "at int, once binary, more binary").repartition(ROWS * shards_of(bits), "at").sortWithinPartitions("at")
    parts.mapInArrow(lambda batches: merge_shards(batches, uri, bits), "at int, cells long").agg(F.sum("cells")).collect()
    del parts
    release(spark)

    def doubtful(batches):
        held, total = [], 0
        for part in text_slices(batches):
            (h, g), owner, first = window_hashes(part.column("text").to_pylist(), seed)
            alive = estimated_repeated(h, uri, bits)
            at = owner[alive]
            held.append((h[alive].view(np.int64), g[alive].view(np.int64), part.column("doc_id").to_numpy()[at], part.column("mark").to_numpy()[at], first[alive].astype(np.int32)))
            total += len(alive)
            if total > FLUSH // 2:
                yield from sent_off(tuple(map(np.concatenate, zip(*held, strict=True))), buckets)
                held, total = [], 0
        if total:
            yield from sent_off(tuple(map(np.concatenate, zip(*held, strict=True))), buckets)

    # A group has a row for each task and place in its smallest document there, however many documents share the window.
    met = docs.select("doc_id", "text", "mark").mapInArrow(doubtful, PARCEL).repartition("bucket").sortWithinPartitions("bucket")
    known = met.mapInArrow(lambda batches: between_tasks(batches, buckets), PARCEL).repartition("bucket").sortWithinPartitions("bucket")
    found = written(known.mapInArrow(by_document, LISTED), "repeated-positions")
    remove_dir(spark, uri)
    del met, known
    release(spark)
    return found


def covered_words(positions: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words lies in a window that starts at one of the positions."""
    change = np.zeros(n + WINDOW + 1, np.int64)
    np.add.at(change, positions, 1)
    np.add.at(change, positions + WINDOW, -1)
    return np.cumsum(change)[:n] > 0


def with_positions(df: DataFrame) -> tuple[DataFrame, str]:
    """All rows and columns of df, and the positions found for them (null if none) under a generated name, which comes second."""
    ids, marks, positions = (f"{n}_{uuid.uuid4().hex}" for n in LISTED.names)
    found = repeated_positions(df).toDF(ids, marks, positions)
    return df.join(found, (df["doc_id"].cast("long") == F.col(ids)) & (F.xxhash64(df["text"]) == F.col(marks)), "left").drop(ids, marks), positions


def dedup_digest(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    rows, positions = with_positions(df.select("doc_id", F.col("text").cast("string").alias("text")))

    def run(batches):
        merged.cache_clear()
        for part in text_slices(batches):
            words, removed, digests = [], [], []
            for t, p in zip(part.column("text").to_pylist(), part.column(positions).to_pylist(), strict=True):
                w = (t or "").encode().split()
                gone = covered_words(np.array(p or [], np.int64), len(w))
                words.append(len(w))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g] if p else w)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return rows.mapInArrow(run, out)


def without_repeats(df: DataFrame) -> DataFrame:
    """The documents with all their columns, repeated passages cut out of their texts.

    A text that loses words keeps the others joined by single spaces, and n_chars follows; all rows stay.
    """
    schema = df.schema
    rows, positions = with_positions(df)

    def run(batches):
        merged.cache_clear()
        for part in text_slices(batches):
            texts = []
            for t, p in zip(part.column("text").to_pylist(), part.column(positions).to_pylist(), strict=True):
                if t is not None and p:
                    w = t.encode().split()
                    t = b" ".join([x for x, g in zip(w, covered_words(np.array(p, np.int64), len(w)).tolist(), strict=True) if not g]).decode()
                texts.append(t)
            columns = {n: part.column(n) for n in schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=schema.names)

    return rows.mapInArrow(run, schema)
