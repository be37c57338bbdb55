"""Greedy choice in an order: a row is taken unless it shares a key with a row taken before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import scratch, shared_dir, written

MOST_ROUNDS = 200


def first_without_shared(keys: DataFrame) -> DataFrame:
    """id of the rows taken, from all pairs (id, key) of the rows, as a loop over the ids in order would take them.

    In each round a row that is least under all its keys is taken, as no row before it is left, and what shares a key with
    it goes. So only rows that are taken keep others out, and a chain of near copies doesn't vanish behind its first. A
    round costs sums by key; rounds are as many as the longest chain of ids that keep each other waiting.
    """
    spark = keys.sparkSession
    out = shared_dir(spark, "taken")
    with scratch(spark):
        left, taken = written(keys.where("id IS NOT NULL").select("id", "key").distinct(), "left"), None
        for _ in range(MOST_ROUNDS):
            heads = left.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n"))
            met = written(left.join(heads, "key"), "met")
            now = written(met.groupBy("id").agg(F.bool_and(F.col("id") == F.col("head")).alias("first")).where("first").select("id"), "now")
            taken = now if taken is None else taken.unionByName(now)
            gone = met.where("n > 1").join(now.withColumnRenamed("id", "head"), "head", "left_semi").select("id").unionByName(now).distinct()
            left = written(left.join(gone, "id", "left_anti"), "left")
            if not left.limit(1).count():
                return written(taken, "", out)
    raise RuntimeError("the choice did not end")
