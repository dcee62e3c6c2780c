"""Running values and neighbours along an order, for keys of any size.

A plain window puts all rows of a key into one task. Here rows are numbered by a global sort, cut into chunks, worked on chunk
by chunk, and joined by what the chunks before hand over; a key's chunks are few, so that their own window is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sizelake.operators.ordering import dense_index

CHUNK = 65_536


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, chunk: int = CHUNK, inclusive: bool = True) -> DataFrame:
    """df with, for each name of `sums`, the running sum of its expression and, for each of `lasts`, the last non-null value
    of its expression, over the rows of the same key up to this one (without it if not inclusive). order should be total
    within the key; ties get an arbitrary but single order. Rows with a null key form a key of their own."""
    sums, lasts = sums or {}, lasts or {}
    made = {f"__s_{n}": F.coalesce(e, F.lit(0)) for n, e in sums.items()} | {f"__l_{n}": F.struct(e.alias("v")) for n, e in lasts.items()}
    base = dense_index(df.withColumns(made), [key, *order], "__idx")
    base = base.withColumns({f"__l_{n}": F.when(F.col(f"__l_{n}.v").isNotNull(), F.col(f"__l_{n}")) for n in lasts})
    base = base.withColumns({"__chunk": F.floor(F.col("__idx") / chunk), "__key": F.struct(key)})
    w = W.partitionBy("__key", "__chunk").orderBy("__idx").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = base.withColumns({f"__rs_{n}": F.coalesce(F.sum(f"__s_{n}").over(w), F.lit(0)) for n in sums} | {f"__rl_{n}": F.last(f"__l_{n}", ignorenulls=True).over(w) for n in lasts})
    ends = base.groupBy("__key", "__chunk").agg(F.count("*").alias("__n"), *[F.sum(f"__s_{n}").alias(f"__cs_{n}") for n in sums], *[F.max_by(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), F.col("__idx"))).alias(f"__cl_{n}") for n in lasts])
    b = W.partitionBy("__key").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    handed = ends.withColumns({f"__bs_{n}": F.coalesce(F.sum(f"__cs_{n}").over(b), F.lit(0)) for n in sums} | {f"__bl_{n}": F.last(f"__cl_{n}", ignorenulls=True).over(b) for n in lasts})
    handed = handed.select("__key", "__chunk", *[f"__bs_{n}" for n in sums], *[f"__bl_{n}" for n in lasts])
    out = local.join(handed, ["__key", "__chunk"])
    return out.select(
        *df.columns,
        *[(F.col(f"__rs_{n}") + F.col(f"__bs_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"__rl_{n}", f"__bl_{n}")["v"].alias(n) for n in lasts],
    )


def neighbours(df: DataFrame, key: str, order: list[str], value: str, k: int, chunk: int = CHUNK) -> DataFrame:
    """df with `before` and `after`: the values of up to k rows of the same key on either side, in order. Rows near the end
    of a chunk are copied to the next one, so that chunks are independent."""
    base = dense_index(df, [key, *order], "__idx").withColumns({"__home": F.floor(F.col("__idx") / chunk), "__key": F.struct(key)})
    near = F.array(F.col("__home"))
    near = F.concat(near, F.when(F.col("__idx") % chunk < k, F.array(F.col("__home") - 1)).otherwise(F.array().cast("array<bigint>")))
    near = F.concat(near, F.when(F.col("__idx") % chunk >= chunk - k, F.array(F.col("__home") + 1)).otherwise(F.array().cast("array<bigint>")))
    w = W.partitionBy("__key", "__chunk").orderBy("__idx")
    wide = base.withColumn("__chunk", F.explode(near))
    wide = wide.withColumns({"before": F.collect_list(value).over(w.rowsBetween(-k, -1)), "after": F.collect_list(value).over(w.rowsBetween(1, k))})
    return wide.where("__chunk = __home").select(*df.columns, "before", "after")
