"""What the operators of this package share: bounded Arrow slices, folders that every executor sees, held-out folds."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.folders import make_dir, remove_dir, scratch, shared_dir, written  # noqa: F401

#: Bytes of text that a Python worker turns into arrays at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch from the JVM, so that long texts do not fill memory.
BATCH_BYTES = "4m"
#: Rows that Spark's Parquet reader decodes at once, for the same reason: its buffers hold all texts of a batch.
READER_ROWS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Holds batches of rows to few bytes: documents can be very long, and a batch stands in memory at once.

    The plans that follow run later, so the two settings stay in the caller's session; they bound memory and change no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches where about `size` bytes of text are reached; no text is cut."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(df: DataFrame, fields: list[tuple[str, T.DataType]], work: Callable[[list[str | None]], list[list]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs work on bounded lists of whole texts; it returns one list of values for each field. The key goes through.

    Only key and text are read, so other columns may have any name. Rows stay as they are, repeated ones included.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    narrow = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], *(T.StructField(n, t) for n, t in fields)])
    schema.fields[0].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(t) for _, t in fields]
        for part in text_slices(batches):
            values = work(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=schema.names)

    return narrow.mapInArrow(run, schema)


def crc_fold(key: str, folds: int, held: int) -> Column:
    """Whether crc32 of the key as text leaves `held` modulo `folds`; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == held, F.lit(False))


def release(spark: SparkSession) -> None:
    """Asks both garbage collectors of the driver to run, so that Spark's cleaner drops the shuffle files of finished jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def file_system(uri: str):
    """pyarrow's file system for a URI, and the path in it; works inside Python workers."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


SPREAD = 1 << 20
#: Label values that a classifier learns: the most frequent ones, ties by value. A column of dirty labels can't grow the sample.
MOST_VALUES = 200


def picked_keys(df: DataFrame, label: str, per_value: int, key: str) -> DataFrame:
    """Rows whose key's hash falls below a threshold that leaves about per_value rows of each label value, 2 * per_value a value at most on average.

    The same rows whenever it runs: where more pass, those with the least hashes stay.
    """
    values = df.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(label).alias("v")).agg(F.count("*").alias("n"))
    counts = {r["v"]: r["n"] for r in values.orderBy(F.desc("n"), "v").limit(MOST_VALUES).collect()}
    chosen = F.lit(False)
    for value in sorted(counts):
        cut = max(1, min(SPREAD, round(SPREAD * per_value / counts[value])))
        chosen = chosen | ((F.col(label) == F.lit(value)) & (F.pmod(F.xxhash64(key), F.lit(SPREAD)) < cut))
    return df.where(chosen).orderBy(F.xxhash64(key), key, label).limit(2 * per_value * max(1, len(counts)))


def labelled_sample(df: DataFrame, label: str, per_value: int, key: str = "doc_id", max_chars: int = 20_000) -> list[tuple]:
    """About per_value rows (text, label) of each label value for fitting a classifier, picked by the key's hash.

    At most twice per_value rows a value come to the driver, each of max_chars at most, so the bound holds at any input size.
    """
    rows = picked_keys(df.select(key, "text", label), label, per_value, key).where(F.length("text") <= max_chars)
    return sorted((r["text"], r[label]) for r in rows.select("text", label).collect())
