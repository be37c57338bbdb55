"""Exact top-k by inner product: an impact-ordered index, read score at a time, with a proof before it stops.

Each task turns its rows into blocks. A block's index has, for each dimension and each quantised signed impact, the
segment of its rows with that impact. A query orders the segments by the size of impact times its own weight and adds
them up, largest first. What a segment leaves open (the width of its impact) and what unread segments can still add are
known, so each row's score has bounds at any time. Some rows of high sums are scored exactly on the way, and the k-th
best of these is a lower bound; reading stops when it is proven that few rows can still reach it, or at the end; every
row whose upper bound reaches it is then rescored exactly in integers. Ties go to the smaller vec_id. Queries come to the tasks in blocks from a table in the shared folder, so neither side is held as a whole and
nothing is broadcast; each task sends k rows for each query and block.

Inner products are exact whatever the size of components. Vectors whose components or number of components are so
large that a sum might leave 64 bits are wide; pairs with a wide one on either side are scored in whole numbers of any
length, past the index. Ranks follow the exact scores; a score beyond 64 bits shows as the nearest that 64 bits hold.

Defined results: vectors that are null or hold null or non-finite components take no part on either side; shorter
vectors count as zero-filled; rows equal in vec_id and vector count once; rows that repeat a query's vec_id with another
vector are queries and candidates of their own; a query's own row is no candidate; an empty table gives no rows; ties go
to the smaller vec_id; only vec_id and the vectors are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import file_system, shared_dir

#: Rows of a block, queries read at once, steps of a quantised impact on either side of zero. A task takes a block.
BLOCK, QUERIES, LEVELS = 16_384, 512, 8
#: A vector is plain if it has so many components at most, each smaller than this in size: 2**16 * 2**23 * 2**23 < 2**63.
MOST_PLAIN, MOST_DIMS = 1 << 23, 1 << 16
#: Reading goes on while more than this share of a block's rows can be members, tested after these shares of the segments.
FEW, TESTS = 0.25, (0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.85)
#: Rows of the highest sums that a test scores exactly, for a lower bound on the k-th best.
PROBES = 32


def whole(x: float, scale: int) -> int:
    """floor(scale * x) of a finite x, exactly."""
    n, d = x.as_integer_ratio()
    return n * scale // d


def vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """From a list column of doubles: plain vectors as a zero-filled matrix, the places of wide ones, and these as lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    sizes = np.diff(offsets)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)  # exact below MOST_PLAIN, as the scale is a power of two
    large = np.append(0, np.cumsum(~(np.abs(scaled) < MOST_PLAIN)))
    wide = np.flatnonzero((large[offsets[1:]] > large[offsets[:-1]]) | (sizes > MOST_DIMS))
    plain = np.ones(len(sizes), bool)
    plain[wide] = False
    out = np.zeros((len(sizes), int(sizes[plain].max(initial=0))), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    some = plain[rows]
    out[rows[some], (np.arange(len(flat)) - np.repeat(offsets[:-1], sizes))[some]] = scaled[some].astype(np.int64)
    return out, wide, [[whole(v, scale) for v in flat[offsets[w] : offsets[w + 1]].tolist()] for w in wide.tolist()]


def product(a: list[int], b: list[int]) -> int:
    return sum(x * y for x, y in zip(a, b, strict=False))


def shown(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


class Block:
    """Rows and their segments: one for each dimension and level, the rows in it and the middle and half width of its impacts."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.whole, self.largest = ids, x, x.astype(np.float64), int(np.abs(x).max(initial=0))
        n, dims = x.shape
        most = np.maximum(np.abs(x).max(0, initial=1), 1)
        self.width = -(-(2 * most + 1) // (2 * LEVELS))  # of a level, by dimension
        level = (x + most) // self.width
        self.count = 2 * LEVELS + 1
        code = level + np.arange(dims) * self.count
        order = np.argsort(code.T.ravel(), kind="stable")
        self.rows = order % max(n, 1)
        self.cuts = np.searchsorted(code.T.ravel()[order], np.arange(dims * self.count + 1))
        low = np.arange(self.count)[None] * self.width[:, None] - most[:, None]
        self.middle = (low + (self.width[:, None] - 1) / 2).ravel()
        self.half = np.repeat((self.width - 1) / 2, self.count)
        self.dim = np.repeat(np.arange(dims), self.count)

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products; by floating point where all sums stay whole numbers below 2**53."""
        if int(np.abs(q).sum()) * self.largest < 1 << 53:
            return (self.whole[at] @ q.astype(np.float64)).astype(np.int64)
        return self.x[at] @ q

    def best(self, q: np.ndarray, own: list[int], k: int) -> np.ndarray:
        """Rows that are in the top k, by exact score and then by id, without those at the query's own places."""
        n = len(self.ids)
        gain = q[self.dim] * self.middle
        order = np.argsort(-np.abs(gain), kind="stable")
        order = order[(self.cuts[order + 1] > self.cuts[order])]
        sums, done, known = np.zeros(n), 0, -np.inf
        alive = np.delete(np.arange(n), own)
        reach = np.zeros(len(q))
        np.maximum.at(reach, self.dim[order], np.abs(gain[order]))
        spread = float((np.abs(q) * (self.width - 1) / 2).sum())
        for share in (*TESTS, 1.0):
            stop = int(len(order) * share)
            for s in order[done:stop].tolist():
                sums[self.rows[self.cuts[s] : self.cuts[s + 1]]] += gain[s]
            done = stop
            # A row has one segment in each dimension; unread ones add at most the largest unread gain of each.
            rest = np.zeros(len(q))
            np.maximum.at(rest, self.dim[order[done:]], np.abs(gain[order[done:]]))
            slack = rest.sum() + spread + 1e-9 * (1 + reach.sum())  # the last for rounding
            if len(alive) > k:
                now = sums[alive]
                most = min(len(alive), max(k, PROBES))
                probes = self.scores(alive[np.argpartition(now, len(now) - most)[len(now) - most :]], q)
                known = max(known, float(np.partition(probes, most - k)[most - k]))
                alive = alive[now + slack >= known]
            if len(alive) <= max(FEW * n, k):
                break
        exact = self.scores(alive, q)
        return alive[np.lexsort((self.ids[alive], -exact))[:k]]


@cache
def query_files(uri: str) -> tuple:
    from pyarrow import fs as pafs

    fs, path = file_system(uri)
    return fs, tuple(sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")))


def query_blocks(uri: str):
    """(numbers, ids, list column) of the query table, in blocks."""
    import pyarrow.parquet as pq

    fs, files = query_files(uri)
    for f in files:
        with fs.open_input_file(f) as source:
            for batch in pq.ParquetFile(source).iter_batches(QUERIES):
                yield batch.column("number").to_numpy(), batch.column("id").to_numpy(), batch.column("x")


def sort_key(score: int) -> str:
    """A text that sorts as the scores do among those that show alike: one for all that 64 bits hold, others beyond."""
    if score == shown(score):
        return "5"
    digits = str(abs(score))
    key = f"{len(digits):04d}{digits}"
    return f"9{key}" if score > 0 else "0" + key.translate(str.maketrans("0123456789", "9876543210"))


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every row whose vec_id is divisible by `every`; scale is a power of two."""
    spark = df.sparkSession
    number = F.col("embedding").cast("array<double>")
    finite = F.forall(number, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    some = df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & number.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("id"), number.alias("x"))
    # A stated number of rows a task: the work is quadratic, so partitions must not be merged for being small in bytes.
    parts = max(spark.sparkContext.defaultParallelism, -(-some.select("id").count() // BLOCK))
    rows = some.repartition(parts, "id").dropDuplicates(["id", "x"])
    uri = shared_dir(spark, "top-k-queries")
    # Numbers tell apart the queries that share an id; written once, they stay the same.
    rows.where(F.col("id") % every == 0).withColumn("number", F.monotonically_increasing_id()).write.parquet(uri)

    def search(batches):
        held: list[pa.RecordBatch] = []

        def found():
            table = pa.Table.from_batches(held).combine_chunks()
            every_id, column = table.column("id").to_numpy(), table.column("x").chunk(0)
            matrix, wide, wide_rows = vectors(column, scale)
            plain = np.delete(np.arange(len(every_id)), wide)
            place = np.cumsum(np.isin(np.arange(len(every_id)), plain)) - 1
            block = Block(every_id[plain], matrix[plain])
            at: dict[int, list[int]] = {}
            for j, x in enumerate(every_id.tolist()):
                if x % every == 0:
                    at.setdefault(x, []).append(j)
            out: list[tuple[int, int, int, int]] = []
            for numbers, ids, lists in query_blocks(uri):
                q, wide_q, wide_lists = vectors(lists, scale)
                w = max(q.shape[1], block.x.shape[1])
                if w > block.x.shape[1]:
                    block = Block(block.ids, np.pad(block.x, ((0, 0), (0, w - block.x.shape[1]))))
                q = np.pad(q, ((0, 0), (0, w - q.shape[1])))
                wide_at = dict(zip(wide_q.tolist(), wide_lists, strict=True))
                for i, (n, own) in enumerate(zip(numbers.tolist(), ids.tolist(), strict=True)):
                    mine = {j for j in at.get(own, ()) if column[j].as_py() == lists[i].as_py()}
                    if i in wide_at:  # every row, past the index
                        best = [(-product(wide_at[i], matrix[j].tolist()), int(every_id[j])) for j in plain.tolist() if j not in mine]
                    else:
                        hit = block.best(q[i], [int(place[j]) for j in mine], k)
                        best = list(zip((-block.scores(hit, q[i])).tolist(), block.ids[hit].tolist(), strict=True))
                    if len(wide):
                        vector = wide_at[i] if i in wide_at else q[i].tolist()
                        best += [(-product(vector, x), int(every_id[j])) for j, x in zip(wide.tolist(), wide_rows, strict=True) if j not in mine]
                    out += [(n, own, j, -s) for s, j in heapq.nsmallest(k, best)]
            if out:
                a, b, c, scores = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array([sort_key(s) for s in scores]), pa.array([shown(s) for s in scores], pa.int64())], names=["number", "query_id", "vec_id", "order", "score"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield from found()
                held, n = [], 0
        if n:
            yield from found()

    hits = rows.mapInArrow(search, "number long, query_id long, vec_id long, order string, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.desc("order"), "vec_id")
    return hits.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
