"""Builds a pool of prompts to quotas: asks for candidates, cleans them, and asks again for what cleaning took.

A round asks each category that lacks prompts for a fifth more than it lacks, and one; rounds end when nothing lacks or
after `rounds` of them. What stays of a round is written to the shared folder, so rounds don't recompute each other. The
driver holds a number for each category and nothing that grows with the pool.

Candidates are cleaned in this order: contaminated ones go; exact copies of an accepted or an earlier one of the round
go; near copies by bands of one that is taken go; then a leaf takes no more than its cap. Rows beyond a cap still keep
near copies of their round out, as caps are counted last. Then sources are interleaved within a category, categories within the pool.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .greedy import first_without_shared
from .ordered import rank_within, with_position, written

#: The columns that a backend's candidates have; ord is unique, and earlier candidates have smaller ones.
CANDIDATE = "ord long, category string, source string, leaf string, key string, bands array<string>, contaminated boolean"


def largest_remainder(shares: dict[str, float], total: int) -> dict[str, int]:
    """Whole numbers in proportion to the shares that sum to total; ties of fractions go to the smaller name."""
    whole = sum(shares.values())
    if whole <= 0:
        return dict.fromkeys(shares, 0)
    exact = {k: total * v / whole for k, v in shares.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def clean(new: DataFrame, accepted: DataFrame | None, cap: int) -> DataFrame:
    """Those of the round's candidates that stay."""
    left = new.where("NOT coalesce(contaminated, false)")
    if accepted is not None:
        left = left.join(accepted.select("key").distinct(), "key", "left_anti")
    left = left.join(left.groupBy("key").agg(F.min("ord").alias("ord")).select("ord"), "ord", "left_semi")
    keys = left.select("ord", F.posexplode("bands").alias("band", "bk"))
    if accepted is not None:
        old = accepted.select(F.posexplode("bands").alias("band", "bk")).distinct()
        copies = keys.join(old, ["band", "bk"], "left_semi").select("ord").distinct()
        keys, left = keys.join(copies, "ord", "left_anti"), left.join(copies, "ord", "left_anti")
    # Within the round only rows that are taken keep near ones out, as a loop over them would have it.
    taken = first_without_shared(keys.select(F.col("ord").alias("id"), F.concat_ws(":", "band", "bk").alias("key")))
    bandless = left.where("bands IS NULL OR size(bands) = 0").select("ord")
    left = written(left.join(taken.select(F.col("id").alias("ord")).unionByName(bandless), "ord", "left_semi"), "pool-round")
    before = accepted.groupBy("leaf").agg(F.count("*").alias("had")) if accepted is not None else None
    ranked = rank_within(left, "leaf", by="ord")
    if before is not None:
        ranked = ranked.join(before, "leaf", "left")
    had = F.coalesce(F.col("had"), F.lit(0)) if before is not None else F.lit(0)
    return ranked.where(F.col("leaf").isNull() | (F.col("rank") + had < cap)).select(new.columns)


def build(spark: SparkSession, request: Callable[[dict[str, int], int], DataFrame], shares: dict[str, float], total: int, cap: int, rounds: int = 4) -> DataFrame:
    """prompt_id, category, source, ord of a pool of `total` prompts at most, in `shares` of categories.

    request(wanted, round) gives candidates, as CANDIDATE, of each category as many as wanted or fewer. A category whose
    backend runs dry stays short. Weights of a category's sources are what each delivered.
    """
    quotas = largest_remainder(shares, total)
    accepted, wanted = None, {c: n for c, n in quotas.items() if n}
    for number in range(rounds + 1):
        if not wanted:
            break
        new = written(request(wanted, number), "pool-candidates")
        kept = clean(new, accepted, cap)
        accepted = written(kept if accepted is None else accepted.unionByName(kept), "pool-accepted")
        have = {r["category"]: r["n"] for r in accepted.groupBy("category").agg(F.count("*").alias("n")).collect()}
        wanted = {c: math.ceil(1.2 * (q - have.get(c, 0))) + 1 for c, q in quotas.items() if q > have.get(c, 0)}
    if accepted is None:
        accepted = spark.createDataFrame([], CANDIDATE)
    rows = accepted.select("ord", "category", "source")
    sizes = rows.groupBy("category", "source").agg(F.count("*").alias("w"))
    share = (F.col("rank") + 1).cast("double") / F.col("w")
    within = rank_within(rows, "category", "source", by="ord").join(sizes, ["category", "source"]).select("ord", "category", "source", share.alias("share"))
    placed = rank_within(within, "category", by=("share", "source"))
    limits = spark.createDataFrame(sorted(quotas.items()), "category string, quota long")
    taken = placed.join(F.broadcast(limits), "category").where("rank < quota")  # a row for each category
    mixed = taken.select("ord", "category", "source", ((F.col("rank") + 1).cast("double") / F.col("quota")).alias("share"))
    return with_position(mixed, "share", "category").select(F.lpad(F.col("position").cast("string"), 10, "0").alias("prompt_id"), "category", "source", "ord")
