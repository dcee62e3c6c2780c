"""Streams: windows over event time with late data, change-only appends, job states. The reference semantics of state are
those of the batch queries; a stream that has read everything gives their rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sizelake.operators.matching import rank_in_key
from sizelake.session import cut

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", a_time: int = 1) -> DataFrame:
    """The files of a folder as they come; event times are session timestamps."""
    raw = spark.read.parquet(f"{folder}/{pattern}").schema
    s = spark.readStream.schema(raw).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", a_time).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "6 hours", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by window and type; rows later than `late` behind the greatest event time seen are dropped by the engine."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once however often it is delivered, with state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _drop_epochs(spark: SparkSession, folder: str, before: int) -> None:
    """Takes away the states of batches that no repeat can need."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("epoch=") and int(name[6:]) < before:
            fs.delete(f.getPath(), True)


def append_changes(batch: DataFrame, epoch: int, path: str, key: list[str], payload: list[str], order: list[str] | None = None) -> None:
    """foreachBatch: appends the rows whose payload differs from the one before under their key, within the batch (in `order`,
    else by payload) as well as from batch to batch. The same rows or the same batch again append nothing.

    Below `path` stand `changes`, which only grows, and `last/epoch=n`, the last payload's hash by key as of a batch; a batch
    reads the newest of these only, not the history, and a batch that is repeated begins from the one before it. The state is
    written after the changes, each batch in a place of its own, so that a batch broken off between is written over whole."""
    spark = batch.sparkSession
    rows = cut(batch.withColumn("__h", F.xxhash64(*payload)))
    heads = f"{path}/last"
    known = None
    if _exists(spark, heads):
        before = spark.read.parquet(heads).where(F.col("epoch") < epoch)
        newest = before.agg(F.max("epoch")).first()[0]  # from the names of the folders
        known = before.where(F.col("epoch") == newest).drop("epoch") if newest is not None else None
    if known is None:
        known = rows.select(*key, F.lit(None).cast("bigint").alias("__last")).limit(0)
    place = rank_in_key(rows, key, [*(order or []), "__h"], "__at")
    prev = place.select(*key, (F.col("__at") + 1).alias("__at"), F.col("__h").alias("__prev"))
    same = lambda x, y, names: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in names]
    with_prev = place.alias("x").join(prev.alias("p"), same("x", "p", [*key, "__at"]), "left").select("x.*", "p.__prev")
    seen = with_prev.alias("x").join(known.alias("k"), same("x", "k", key), "left").select("x.*", "k.__last")
    changed = seen.where(~F.col("__h").eqNullSafe(F.coalesce("__prev", "__last")))
    changed.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")
    ends = place.groupBy(*key).agg(F.max_by("__h", "__at").alias("__last"))
    kept = known.alias("k").join(ends.alias("e"), same("k", "e", key), "left_anti")
    ends.unionByName(kept.select(*key, "__last")).write.mode("overwrite").parquet(f"{heads}/epoch={epoch}")
    _drop_epochs(spark, heads, epoch - 1)


class JobStates(StatefulProcessor):
    """Per job its state: waiting → running → done, failed or broken off. Events that don't fit the state are reported, not
    applied. A job that is running is broken off once event time has gone on for ttl_ms behind its start: a timer is set when
    it starts, and taken back when it ends."""

    NEXT = {None: {"waiting"}, "waiting": {"running", "broken"}, "running": {"done", "failed", "broken"}, "broken": {"waiting"}}

    def __init__(self, ttl_ms: int = 3_600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, since timestamp, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, since, timer = self.state.get() if self.state.exists() else (None, None, None)
        refused = 0
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        for want, at in zip(every["event_type"], every["ts"], strict=True):
            if want in self.NEXT.get(state, set()):
                state, since = want, at.to_pydatetime()
            else:
                refused += 1
        due = int(pd.Timestamp(since).timestamp() * 1000) + self.ttl_ms if state == "running" else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if state is not None:
            self.state.update((state, since, due))
        yield pd.DataFrame({"job": [key[0]], "state": [state], "since": [since], "refused": [refused]}).astype({"state": object})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, since, timer = self.state.get() if self.state.exists() else (None, None, None)
        if state == "running" and timer == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update(("broken", since, None))
            yield pd.DataFrame({"job": [key[0]], "state": ["broken"], "since": [since], "refused": [0]}).astype({"state": object})

    def close(self) -> None:
        pass


def job_states(events: DataFrame, ttl_ms: int = 3_600_000, late: str = "0 seconds") -> DataFrame:
    """(job, state, since, refused) after each micro-batch, and for jobs whose time is over; events have user_id as the job."""
    e = events.withWatermark("ts", late)
    return e.groupBy("user_id").transformWithStateInPandas(JobStates(ttl_ms), "job bigint, state string, since timestamp, refused int", "Update", "EventTime")


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what is there, into a table in memory; for tests and one-off loads."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
