"""Connected components of an edge table by alternating large and small stars; no node's edges meet in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import remove_dir, shared_dir

MOST_ROUNDS = 60


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root: the least node reachable, for every node that is not itself the least of its component.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round; the round
    before it is deleted. Null ends and loops are ignored, repeated edges count once, no edges give no rows.
    """
    spark = edges.sparkSession
    base = shared_dir(spark, "components")

    def kept(df: DataFrame, round_: int) -> tuple[DataFrame, tuple]:
        df.write.parquet(f"{base}/{round_}")
        back = spark.read.schema(df.schema).parquet(f"{base}/{round_}")
        return back, tuple(back.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    star, mark = kept(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where((F.col(u) != F.col(v))).distinct(), 0)
    if not mark[0]:
        return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for k in range(1, MOST_ROUNDS):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        star, now = kept(small, k)
        remove_dir(spark, f"{base}/{k - 1}")
        if now == mark:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")
