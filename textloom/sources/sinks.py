"""Writers: frozen pools with checksums, shards with a manifest, indexes, reports and results, tables replaced whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folders import hadoop_path, remove_dir
from ..operators.ordered import with_position
from .files import CompressedLines, TokenFiles


def freeze_pool(records: DataFrame, path: str, version: str) -> dict:
    """Writes records in key order as canonical JSON lines, each key the padded position, and a manifest with a checksum of all lines' hashes."""
    placed = with_position(records, "prompt_id")
    if placed.where(F.lpad(F.col("position").cast("string"), 10, "0") != F.col("prompt_id")).limit(1).count():
        raise ValueError("prompt_id differs from position")
    columns = sorted(c for c in records.columns)
    lines = placed.select("position", F.to_json(F.struct(*columns)).alias("value"))
    ranged = lines.repartitionByRange("position").sortWithinPartitions("position")
    ranged.select("value").write.text(path)
    # The digest of digests is over blocks of lines, so no task takes all of them.
    blocks = lines.groupBy(F.floor(F.col("position") / 4096).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.sha2("value", 256).alias("h")))), lambda x: x["h"]), ""), 256).alias("h"), F.count("*").alias("n"))
    total = blocks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("sha"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return {"version": f"pool-{version}-{total['sha'][:12]}", "sha256": total["sha"], "n_records": total["n"]}


def write_shards(records: DataFrame, path: str, by: str = "teacher") -> DataFrame:
    """Parquet by teacher, and a row of totals for each as its manifest."""
    records.write.partitionBy(by).parquet(path)
    return records.groupBy(by).agg(F.count("*").alias("n_offered"), F.count_if("retained").alias("n_retained"), F.sum(F.when(F.col("retained"), F.col("tokens_student"))).alias("tokens_student_retained"))


def union_index(frames: list[DataFrame]) -> DataFrame:
    """One index from runs with different columns, in the order in which columns are first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_index(frames: list[DataFrame], uri: str) -> None:
    """One index from several runs, as CSV and as Parquet beside it."""
    whole = union_index(frames)
    whole.write.parquet(f"{uri}.parquet")
    back = whole.sparkSession.read.parquet(f"{uri}.parquet")
    back.select([F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in back.dtypes]).write.option("header", True).csv(f"{uri}.csv")


def save_whole(df: DataFrame, uri: str) -> None:
    """Replaces what stands at uri by df, whole or not at all: written beside it, then put in its place by renaming.

    df may be computed from what stands there. Where a store can't rename a folder at once (object stores), a reader may
    find none for a moment, but never a part.
    """
    spark = df.sparkSession
    fresh, old = f"{uri}.new-{uuid.uuid4().hex}", f"{uri}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    target, fs = hadoop_path(spark, uri)
    had = fs.exists(target)
    if had and not fs.rename(target, hadoop_path(spark, old)[0]):
        raise OSError(f"{uri} can't be moved aside")
    if not fs.rename(hadoop_path(spark, fresh)[0], target):
        raise OSError(f"{fresh} can't take its place")
    if had:
        remove_dir(spark, old)


def write_results(results: DataFrame, uri: str, by: tuple[str, ...] = ("run_id", "task")) -> None:
    """Results as JSON, a folder for each run and task."""
    results.write.partitionBy(*by).json(uri)


def write_reports(reports: dict[str, DataFrame], uri: str) -> None:
    """Tables of an analysis as CSV with a header and as JSON lines, under their names."""
    for name, df in reports.items():
        flat = df.select([F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        flat.write.option("header", True).csv(f"{uri}/{name}.csv")
        df.write.json(f"{uri}/{name}.json")


def register(spark: SparkSession) -> None:
    """Makes the package's file formats known to a session."""
    for source in (TokenFiles, CompressedLines):
        spark.dataSource.register(source)
