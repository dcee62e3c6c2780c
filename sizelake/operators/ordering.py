"""A dense index over a total order, made without putting any group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sizelake.session import cut


def dense_index(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """df with a column `name`: 0, 1, 2, ... in the order given (a total order, or equal rows get any of their numbers).

    Sorted by range over all partitions, written once (the sample that a range partitioning rests on may differ if it ran
    again), then numbered within the partition plus the count of rows in the partitions before. What is gathered is one
    count per partition. A group of any size is spread over partitions, unlike with row_number() over a partition."""
    own = [c for c in ("__pos", "__part", "__start") if c in df.columns]
    if own:
        raise ValueError(f"columns {own} are reserved")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = cut(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__pos", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__pos", 33).cast("bigint"))
    counts = sorted((r["__part"], r["n"]) for r in done.groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, k in counts:
        starts.append((part, total))
        total += k
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__part bigint, __start bigint"))  # one row a partition
    within = F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))
    return done.join(offsets, "__part", "left").withColumn(name, within + F.coalesce("__start", F.lit(0))).drop("__pos", "__part", "__start")
