"""What leaves the engine: reports, findings with unique ids, resumable parts, memoised answers."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sizelake.functions.text import cut_hard, table_cell


def markdown_table(df: DataFrame, order: list, most: int = 10_000) -> str:
    """A short, aggregated result as a Markdown table. Results of more than `most` rows are refused: they belong in files."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them to files")
    cell = lambda v: "" if v is None else " ".join(str(v).split()).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def write_findings(df: DataFrame, path: str) -> None:
    """One JSON object a finding; the commit protocol makes the files appear together."""
    df.write.mode("overwrite").json(path)


def write_partition(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a run resumed by its signature has still to do."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def memoised(asked: DataFrame, cache: DataFrame, inputs: list[str]) -> DataFrame:
    """asked with `key` (a hash of the inputs) and, where the cache has it, `answer`; errors are never taken from a cache."""
    key = F.sha2(F.to_json(F.struct(*inputs)), 256)
    good = cache.where("error is null").groupBy("key").agg(F.min("answer").alias("answer"))
    return asked.withColumn("key", key).join(good, "key", "left")


def upsert(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """held with the rows of new: filled fields of new hold, its nulls leave what stands. Keys are unique on both sides."""
    n = new.select(key, *[F.col(c).alias(f"__n_{c}") for c in held.columns if c != key])
    j = held.join(n, key, "full_outer")
    return j.select(key, *[F.coalesce(f"__n_{c}", c).alias(c) for c in held.columns if c != key])


def log_entries(df: DataFrame, text: str, limit: int = 1000) -> DataFrame:
    return df.withColumn(text, cut_hard(F.col(text), limit))


def cells(df: DataFrame, columns: list[str], limit: int = 170) -> DataFrame:
    return df.withColumns({c: table_cell(F.col(c), limit) for c in columns})


def retries(df: DataFrame, at: str, failed: str, first_ms: int = 5000, most: int = 3) -> DataFrame:
    """df with `state` (retry, given up) and `next_at`: after the n-th failure the wait is first_ms * 2^(n-1). A null count is
    a first failure."""
    n = F.coalesce(F.col(failed), F.lit(1))
    wait = (F.lit(first_ms) * F.pow(F.lit(2.0), n - 1) / 1000).cast("decimal(18,3)")
    go = n <= most
    return df.withColumns({"state": F.when(go, "retry").otherwise("given up"), "next_at": F.when(go, F.timestamp_millis(F.unix_millis(F.col(at)) + (wait * 1000).cast("bigint")))})


def claim(spark: SparkSession, folder: str, job: str, waiting: str = "waiting", running: str = "running") -> bool:
    """Whether this caller now owns the job: its file is renamed from waiting-<job> to running-<job>, which one of any number
    of callers can do. On any file system whose rename is atomic."""
    jvm = spark._jvm
    a, b = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{state}-{job}") for state in (waiting, running))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        return bool(fs.exists(a) and not fs.exists(b) and fs.rename(a, b))
    except Exception:  # noqa: BLE001  another caller was quicker
        return False


class ResultCache:
    """Results by key for a limited time; what was written to a resource makes all results of it go.

    A result is persisted in the cluster, never gathered; at most `most` are held, the oldest goes first."""

    def __init__(self, ttl: float = 300.0, most: int = 64, clock=time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self.held: dict[str, tuple[float, DataFrame]] = {}

    def get(self, key: str, make) -> DataFrame:
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.ttl:
            return self.held[key][1]
        self.invalidate(key)
        while len(self.held) >= self.most:
            self._drop(min(self.held, key=lambda k: self.held[k][0]))
        self.held[key] = (now, make().persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[key][1]

    def _drop(self, key: str) -> None:
        self.held.pop(key)[1].unpersist()

    def invalidate(self, resource: str) -> None:
        """Drops the results of a resource: its own key and those below it."""
        for k in [k for k in self.held if k == resource or k.startswith(resource.rstrip("/") + "/") or k.startswith(resource + "?")]:
            self._drop(k)
