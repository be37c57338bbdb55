"""The events table as a stream: windowed counts, sessions, exact dedup; each ends when the files that are there are read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folders import hadoop_path, shared_dir


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over a Parquet directory or file, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    directory = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    folder, _, name = (path, "", "*.parquet") if directory else path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def settled(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Runs a stream over what is there, and reads its output from the shared folder.

    With a folder given as base, a later call goes on from there: its checkpoint says what was read, so only new files are.
    Mode complete keeps all groups as state and returns them as they are at the end, open windows included.
    """
    spark = stream.sparkSession
    base = base or shared_dir(spark, "stream")
    if mode == "complete":
        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number:09d}")

        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        path, fs = hadoop_path(spark, f"{base}/out")
        last = max((str(s.getPath()) for s in fs.listStatus(path)), default=None) if fs.exists(path) else None
        return spark.read.schema(stream.schema).parquet(last) if last else spark.createDataFrame([], stream.schema)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type in sliding windows; windows close when the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in windows that follow each other."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "3600 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts by user in sessions that a gap without events ends."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def diverging(logs: DataFrame, factor: float = 2.0) -> DataFrame:
    """run, longest: from rows (run, ts, step, value) the longest streak of values above `factor` times the run's least so far.

    A run's state is three numbers; a trigger's rows of a run are put in order, rows of later triggers are later. Each
    trigger with rows of a run gives its row anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        low, streak, longest = state.get if state.exists else (float("inf"), 0, 0)
        for v in pd.concat(list(batches)).sort_values(["ts", "step"])["value"].tolist():
            low = min(low, v)
            streak = streak + 1 if v > factor * low else 0
            longest = max(longest, streak)
        state.update((low, streak, longest))
        yield pd.DataFrame({"run": [key[0]], "longest": [longest]})

    return logs.groupBy("run").applyInPandasWithState(step, "run long, longest long", "low double, streak long, longest long", "append", GroupStateTimeout.NoTimeout)


def until_budget(shards: DataFrame, budget: int) -> DataFrame:
    """Rows (worker, shard, tokens) of each worker in order of shard, until the tokens before reach the budget; the state is one sum a worker."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        if spent < budget:
            rows = pd.concat(list(batches)).sort_values("shard")
            before = spent + rows["tokens"].cumsum() - rows["tokens"]
            kept = rows[before < budget]
            state.update((int(spent + kept["tokens"].sum()),))
            yield kept[["worker", "shard", "tokens"]]

    return shards.groupBy("worker").applyInPandasWithState(step, "worker string, shard long, tokens long", "spent long", "append", GroupStateTimeout.NoTimeout)


def stale(beats: DataFrame, limit: float = 3600.0) -> DataFrame:
    """worker, n_stale: from rows (worker, ts) how often a worker's heartbeat stayed out for more than `limit` seconds.

    A worker's state is its last heartbeat and the count; each trigger with rows of a worker gives its row anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (None, 0)
        for t in pd.concat(list(batches))["ts"].sort_values().tolist():
            now = t.timestamp()
            count += last is not None and now - last > limit
            last = now if last is None else max(last, now)
        state.update((last, int(count)))
        yield pd.DataFrame({"worker": [key[0]], "n_stale": [int(count)]})

    return beats.groupBy("worker").applyInPandasWithState(step, "worker long, n_stale long", "last double, n_stale long", "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first row of each event id; the state of an id is dropped when the watermark passes it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
