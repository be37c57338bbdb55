"""Subsamples by a hash order within a category to a quota of tokens, whole rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import scratch, shared_dir, written
from .ordered import with_position

#: Tokens by which a category may exceed its quota.
TOLERANCE = 1024


def equal_tokens(rows: DataFrame, budget: int, tolerance: int = TOLERANCE) -> DataFrame:
    """id, cat, t of the rows (id, cat, pr, t) taken: in the order of pr, then id, a category's rows until its quota is reached.

    A category's quota is its share of all tokens of the budget, rounded half to even. A row that would exceed the quota by
    more than the tolerance is passed over and the next one is tried. Between two rows passed over what is taken is a running
    sum, so each round finds every category's next such row from sums over ranges, and a category is never one task; after
    it, only rows that still fit are looked at. Rows without a category are left aside.
    """
    spark = rows.sparkSession
    out = shared_dir(spark, "equal-tokens")
    with scratch(spark):
        narrow = written(rows.where("cat IS NOT NULL"), "rows")  # dealing by ranges reads its input twice, and counting tokens is dear
        placed = written(with_position(narrow, "cat", "pr", "id").select("id", "cat", "t", "position"), "placed")
        totals = placed.groupBy("cat").agg(F.sum("t").alias("s"), F.min("position").alias("at"))
        whole = totals.agg(F.sum("s").alias("whole"))
        state = written(totals.crossJoin(F.broadcast(whole)).select("cat", F.bround(F.col("s").cast("double") / F.col("whole") * budget).cast("long").alias("quota"), F.lit(0).cast("long").alias("acc"), "at"), "state")
        taken = None
        while True:
            live = placed.join(state, "cat").where((F.col("position") >= F.col("at")) & (F.col("acc") < F.col("quota")) & (F.col("t") <= F.col("quota") + tolerance - F.col("acc")))
            summed = with_position(live.select("id", "cat", "t", "quota", "acc", F.col("position").alias("place")), "cat", "place", total="t")
            base = summed.groupBy("cat").agg(F.min("before").alias("base"))
            run = summed.join(base, "cat").withColumn("sum", F.col("acc") + F.col("before") - F.col("base"))
            ends = run.groupBy("cat").agg(
                F.min(F.when(F.col("sum") >= F.col("quota"), F.col("place"))).alias("stop"),
                F.min(F.when(F.col("sum") + F.col("t") > F.col("quota") + tolerance, F.col("place"))).alias("skip"),
            )
            run = run.join(ends, "cat").where(F.col("place") < F.coalesce(F.least("stop", "skip"), F.lit((1 << 63) - 1)))
            now = written(run.select("id", "cat", "t"), "taken")
            taken = now if taken is None else taken.unionByName(now)
            added = now.groupBy("cat").agg(F.sum("t").alias("added"))
            # Only categories that met a row to pass over before their end go on, behind that row.
            onward = ends.where("skip < coalesce(stop, 9223372036854775807L)").select("cat", "skip")
            state = written(state.join(onward, "cat").join(added, "cat", "left").select("cat", "quota", (F.col("acc") + F.coalesce("added", F.lit(0))).alias("acc"), (F.col("skip") + 1).alias("at")), "state")
            if not state.limit(1).count():
                return written(taken, "", out)
