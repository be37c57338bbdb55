"""Tables of a directory as DataFrames and as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.udfs import register_named

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Tables whose rows cost much more to work on than to move.
TEXTS = ("documents", "pages", "conversations")
#: Bytes for each core below which such a table is dealt out when its files are fewer than the cores.
SMALL_SHARE = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small table of few files to all cores, as a file of one row group is one task otherwise.

    The bound on its size keeps this from ever moving a large table, whose files are tasks enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SMALL_SHARE or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Registers the tables and functions that a SQL text names; a plan is resolved when it is made, so later views don't change it."""
    register_named(spark, text)
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
