"""Positions and running totals in a global order, without one task that sees all rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folders import shared_dir, written  # noqa: F401

#: Bits that a row's place has below its partition's number in monotonically_increasing_id.
PLACE_BITS = 33


def with_position(df: DataFrame, *order: str, total: str | None = None) -> DataFrame:
    """Adds position (from 0) in the given order, and before: the sum of `total` over the rows before, if asked for.

    Rows are dealt by ranges and numbered within them; the ranges' sizes, one row each, give what to add. The order
    should be total; equal rows get positions next to each other. Nulls come first.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "ordered")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged.write.parquet(path)  # a partition's number must not change between the two uses
    kept = spark.read.schema(ranged.schema).parquet(path).withColumn("__part", F.shiftright("__at", PLACE_BITS)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    value = F.coalesce(F.col(total), F.lit(0)) if total else F.lit(0)
    sizes = kept.groupBy("__part").agg(F.count("*").alias("__n"), F.sum(value).alias("__sum"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__rows"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__total"))
    out = kept.join(F.broadcast(sizes), "__part").withColumn("position", F.col("__rows") + F.col("__place"))
    if total:
        within = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("__total") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return out.drop("__at", "__part", "__place", "__rows", "__total")


def rank_within(df: DataFrame, *groups: str, by: str | tuple[str, ...]) -> DataFrame:
    """Adds rank (from 0) within each group: a global position less the group's first, so a large group isn't one task."""
    placed = with_position(df, *groups, *((by,) if isinstance(by, str) else by))
    firsts = placed.groupBy(*groups).agg(F.min("position").alias("__first")).select("__first", *(F.col(g).alias(f"__{g}") for g in groups))
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups))
    return placed.join(firsts, same).select(*df.columns, (F.col("position") - F.col("__first")).alias("rank"))
