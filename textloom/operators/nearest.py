"""Nearest of a stated set of items by cosine, in blocks: neither side is held whole, and no pairs become rows."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import shared_dir

#: Items that a task reads at once.
BLOCK = 4096


def blocks(uri: str):
    """(ids, unit vectors) of the items' table in the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, path = (pafs.LocalFileSystem(), urlparse(uri).path) if urlparse(uri).scheme in ("", "file") else pafs.FileSystem.from_uri(uri)
    for f in fs.get_file_info(pafs.FileSelector(path)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(BLOCK):
                    if batch.num_rows:
                        yield batch.column(0).to_numpy(), np.stack(batch.column(1).to_pylist()).astype(np.float64)


def nearest(rows: DataFrame, items: DataFrame, threshold: float = 0.85, itself: bool = True) -> DataFrame:
    """id, item, cosine, hit: for each row (id, x) the item (id, x) of the highest cosine; of equals the smallest id.

    Unless `itself`, an item with the row's own id is no match.

    Null vectors and zero vectors take no part; all vectors have one length; cosines are rounded to nine digits.
    """
    uri = shared_dir(rows.sparkSession, "items")
    number = F.transform("x", lambda v: v.cast("double"))
    some = F.exists("x", lambda v: v != 0)
    items.where(some).select("id", number.alias("x")).write.parquet(uri)

    def search(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(1).to_pylist()).astype(np.float64)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            own = batch.column(0).to_numpy()
            best, item = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
            for ids, y in blocks(uri):
                s = np.round(x @ (y / np.sqrt((y * y).sum(1, keepdims=True))).T, 9)
                if not itself:
                    s[own[:, None] == ids] = -np.inf
                top = s.max(1)
                least = np.where(s == top[:, None], ids, np.iinfo(np.int64).max).min(1)
                take = (top > best) | (top == best) & (least < item)
                best, item = np.where(take, top, best), np.where(take, least, item)
            seen = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(seen)), pa.array(item[seen]), pa.array(best[seen])], names=["id", "item", "cosine"])

    found = rows.where(some).select("id", number.alias("x")).mapInArrow(search, "id long, item long, cosine double")
    return found.select("id", "item", F.round("cosine", 6).alias("cosine"), (F.col("cosine") >= threshold).alias("hit"))


def judged(found: DataFrame, rows: DataFrame, items: DataFrame, judge: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """found with the hits that judge refuses taken back; rows and items are (id, what it is shown).

    Only hits reach the judge, in Arrow batches, joined to what it is shown by their ids. Ids are unique on both sides.
    """
    hits = found.where("hit").select("id", "item")
    left, right = rows.toDF("id", "shown"), items.toDF("item", "other")
    met = hits.join(left, "id").join(right, "item").select("id", "item", "shown", "other")

    def run(batches):
        for b in batches:
            yield b.loc[judge(b["shown"], b["other"]).astype(bool), ["id"]]

    agreed = met.mapInPandas(run, "id long").withColumn("agreed", F.lit(True))
    return found.join(agreed, "id", "left").select("id", "item", "cosine", (F.col("hit") & F.coalesce("agreed", F.lit(False))).alias("hit"))
