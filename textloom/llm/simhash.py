"""SimHash near-duplicates: fingerprints of word shingles, linked through one-wildcard variants of their halves.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of one 32-bit half. So each half enters an
index 32 times, each time with another bit left out; two halves that differ in at most one bit meet under the key that
leaves it out, and an equality join finds every link, which is then verified. Only different fingerprints enter, each
once. A key's members come as a sorted stream; up to BUCKET of them are linked by a search that yields a spanning forest
and not all pairs. Members of a larger key go on unbuffered and are cut again in the same way: their other half by its
16-bit parts, then the rest by its 8-bit parts, after which a bucket can't hold more than 2,048 fingerprints. A link is
taken only under the first key that its ends share. Defined results: a text without words, or null, has fingerprint
zero, which links like any other; of repeated rows each gets its row; a component's id is its smallest doc_id, nulls
left aside; texts of any length are taken whole; an empty table gives no rows; only doc_id and text are read, so other
columns may have any name. Where one document of a component stays, rows tied in doc_id go by the hash of their text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from .common import map_texts, scratch, shared_dir, written

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Members of a key that are linked at once; at least 2,048, the bound after the third cut.
BUCKET = 4096


def shingle_hashes(text: str) -> list[int]:
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return []
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(s), SEED) for s in zip(words, words[1:], words[2:], strict=False)]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """A 64-bit fingerprint of each text: bits set in over half of its shingles' hashes."""
    hashes = [shingle_hashes(t or "") for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not sizes.sum():
        return out
    flat = np.array([x for h in hashes for x in h], np.uint64)
    # Bits are counted eight at a time in the bytes of a word, over blocks of 255 hashes at most.
    blocks = -(-sizes // 255)
    owner = np.repeat(np.arange(len(texts)), blocks)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    heads = np.repeat(np.cumsum(sizes) - sizes, blocks) + number * 255
    counts = np.zeros((len(texts), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat(flat >> np.uint64(k) & np.uint64(0x0101010101010101), heads)
        np.add.at(counts, (owner[:, None], np.arange(8)[None] * 8 + k), sums.view(np.uint8).reshape(-1, 8))
    bits = (2 * counts > sizes[:, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def with_fingerprint(df: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), fp (64 bits as a long) of every whole text."""
    keyed = df.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("key"), "text")
    return map_texts(keyed, [("fp", T.LongType())], lambda texts: [fingerprints(texts).view(np.int64)], key="key").select("doc_id.doc_id", "doc_id.mark", "fp")


def first_shared(x: np.ndarray) -> np.ndarray:
    """Number of the first key that two fingerprints with difference x share; 64 if none."""
    out = np.full(x.shape, 64, np.int64)
    for base, half in ((32, x & np.uint64(0xFFFFFFFF)), (0, x >> np.uint64(32))):
        bits = np.bitwise_count(half)
        out = np.where(bits == 1, base + np.bitwise_count(half - (half > 0)).astype(np.int64), np.where(bits == 0, base, out))
    return out


def near(a: np.ndarray, b: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """Whether fingerprints link, and first meet under the key of that number."""
    x = a ^ b
    return (np.bitwise_count(x) <= DISTANCE) & (first_shared(x) == (number & 63))


def forest(fps: np.ndarray, number: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among one key's members."""
    left, edges = fps, []
    todo: list[np.uint64] = []
    while len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        while todo and len(left):
            u = todo.pop()
            hit = near(left, u, number)
            if hit.any():
                edges += [(u, x) for x in left[hit]]
                todo += list(left[hit])
                left = left[~hit]
        todo = []
    return edges


def linked(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """From rows (key, number, fp) sorted by key: edges (over false), and members of keys that are too large (over true)."""
    names = ["over", "key", "number", "a", "b"]

    def rows(over: bool, key, number, a, b) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, over)), pa.array(np.asarray(key, np.int64)), pa.array(np.asarray(number, np.int32)), pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64))], names=names)

    def closed(key: np.ndarray, number: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(key)))
        for m in range(2, 9):
            if len(at := heads[sizes == m]):
                i, j = np.triu_indices(m, 1)
                a, b, num = fp[(at[:, None] + i).ravel()], fp[(at[:, None] + j).ravel()], np.repeat(number[at], len(i))
                if (hit := near(a, b, num)).any():
                    yield rows(False, np.zeros(hit.sum()), num[hit], a[hit], b[hit])
        edges = [(number[h], *e) for h, s in zip(heads[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True) for e in forest(fp[h : h + s], int(number[h]))]
        if edges:
            num, a, b = zip(*edges, strict=True)
            yield rows(False, np.zeros(len(a)), num, a, b)

    held = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))
    large = None  # the key whose members pass through
    for batch in batches:
        new = tuple(batch.column(i).to_numpy() for i in range(3))
        key, number, fp = (np.concatenate([a, b]) for a, b in zip(held, (new[0], new[1], new[2].view(np.uint64)), strict=True))
        if large is not None:
            n = int(np.searchsorted(key, large, "right"))
            if n:
                yield rows(True, key[:n], number[:n], fp[:n], fp[:n])
            key, number, fp = key[n:], number[n:], fp[n:]
            if len(key):
                large = None
        if len(key):
            end = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on in the next batch
            if len(key) - end > BUCKET and not last:
                large = key[-1]
                yield rows(True, key[end:], number[end:], fp[end:], fp[end:])
                tail = len(key)
            else:
                tail = end
            # A key that ended within the batch may also be too large; it is whole here, and so is its memory.
            if end:
                yield from closed(key[:end], number[:end], fp[:end])
            held = key[tail:], number[tail:], fp[tail:]
        else:
            held = key, number, fp
    if len(held[0]):
        yield from closed(*held)


OUT = "over boolean, key long, number int, a long, b long"


def links(fps: DataFrame) -> DataFrame:
    """a, b: edges that connect all linked fingerprints of a table of different ones (column fp)."""

    def met(df: DataFrame, *by: str, last: bool = False) -> DataFrame:
        # Equal keys meet in one task as a sorted stream; members are different, so a key isn't a document's copies.
        dealt = df.repartition(*by).sortWithinPartitions(*by, "fp")
        return dealt.select("key", "number", "fp").mapInArrow(lambda batches: linked(batches, last), OUT)

    half = "CASE WHEN number < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END"
    first = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("number")).selectExpr("fp", "number", f"shiftleft(cast(number AS bigint), 32) | (({half}) & ~shiftleft(1L, number & 31)) AS key")
    one = written(met(first, "key"), "simhash-links")
    # The other half, in parts of 16 bits with one left out; then the part that is left, in parts of 8.
    over = one.where("over").select("key", "number", F.col("a").alias("fp"))
    other = "CASE WHEN number & 63 < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END"
    second = over.select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")).selectExpr("key AS key1", "number + 64 * (1 + CAST(i < 16 AS int)) AS number", "fp", f"shiftleft(cast(i AS bigint), 16) | (shiftrightunsigned(({other}), CASE WHEN i < 16 THEN 16 ELSE 0 END) & 65535L & ~shiftleft(1L, i & 15)) AS key2")
    two = written(met(second.selectExpr("xxhash64(key1, key2) AS key", "number", "fp"), "key"), "simhash-links") if over.limit(1).count() else None
    found = one.where("NOT over").select("a", "b")
    if two is not None:
        over = two.where("over").select("key", "number", F.col("a").alias("fp"))
        # number tells which part is shared: from 128 on the high one, so the low one is left.
        byte = "(CAST(i / 8 AS int) + CASE WHEN number >= 128 THEN 0 ELSE 2 END)"
        third = over.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")).selectExpr("number", "fp", f"xxhash64(key, i, shiftrightunsigned(({other}), {byte} * 8) & 255L & ~shiftleft(1L, i & 7)) AS key")
        found = found.unionByName(two.where("NOT over").select("a", "b")).unionByName(met(third, "key", last=True).where("NOT over").select("a", "b"))
    return found.distinct()


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, mark, fp, component_id of every document, and root, which names its component whatever its ids."""
    spark = df.sparkSession
    docs = written(with_fingerprint(df), "simhash-fingerprints")
    kept = shared_dir(spark, "simhash-roots")
    with scratch(spark):
        reps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-different")
        roots = connected_components(links(reps.select("fp")), "a", "b").select(F.col("node").alias("fp"), "root")
        joined = written(reps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "", kept)
    classes = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return docs.join(classes, "fp").select("doc_id", "mark", "fp", "component_id", "root")


def components(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are their component's first: least in doc_id, then in the hash of the text.

    Of rows equal in doc_id and text one stays; rows without doc_id stay.
    """
    ids, marks = (f"{n}_{uuid.uuid4().hex}" for n in ("doc_id", "mark"))
    known = near_duplicates(df).where("doc_id IS NOT NULL")
    first = known.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first")).select(F.col("first.doc_id").alias(ids), F.col("first.mark").alias(marks))
    one = df.withColumn(marks, F.xxhash64("text"))
    # Rows come out of the join sorted by what tells repeated ones, so they need no other exchange.
    one = one.join(first.withColumnRenamed(marks, f"{marks}_"), (one["doc_id"] == F.col(ids)) & (one[marks] == F.col(f"{marks}_")), "left_semi").dropDuplicates(["doc_id", marks])
    return one.select(*(F.col(f"`{c}`") for c in df.columns)).unionByName(df.where("doc_id IS NULL"))
