"""Order-dependent columns without one task for all rows.

Rows are windowed inside buckets of the order column; what crosses a bucket's edge comes from
one row a bucket, which is windowed alone.  With buckets of an epoch that is one short row per
432,000 slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def _bucket(order: str, size: int):
    return F.expr(f"{order} div {size}")


def with_previous(df: DataFrame, order: str, columns: list[str], size: int = BUCKET, prefix: str = "prev_") -> DataFrame:
    """Adds ``prev_<column>`` of the row before; null on the first. ``order`` must be unique and not null."""
    df = df.withColumn("_b", _bucket(order, size))
    inside = Window.partitionBy("_b").orderBy(order)
    here = F.struct(F.col(order).alias("_o"), *columns)
    last = df.groupBy("_b").agg(F.max_by(here, order).alias("_l"))
    carried = last.select(F.col("_b").alias("_cb"), F.lag("_l").over(Window.orderBy("_b")).alias("_c"))
    df = df.withColumn("_p", F.lag(here).over(inside)).join(carried, F.col("_b") == F.col("_cb"))
    p = F.coalesce("_p", "_c")
    return df.withColumns({f"{prefix}{c}": p[c] for c in columns}).drop("_b", "_cb", "_c", "_p")


def with_running(df: DataFrame, order: str, value: str, name: str, how=F.sum, size: int = BUCKET) -> DataFrame:
    """Adds the running sum (or maximum, minimum) of ``value`` up to and with each row."""
    df = df.withColumn("_b", _bucket(order, size))
    inside = how(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    totals = df.groupBy("_b").agg(how(value).alias("_t"))
    before = how("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(F.col("_b").alias("_cb"), before.alias("_c"))
    join = df.withColumn("_i", inside).join(carried, F.col("_b") == F.col("_cb"))
    both = F.col("_i") + F.coalesce("_c", F.lit(0)) if how is F.sum else (F.greatest if how is F.max else F.least)("_i", "_c")
    return join.withColumn(name, both).drop("_b", "_cb", "_c", "_i")


def with_last_present(df: DataFrame, order: str, present, name: str, forward: bool = False, size: int = BUCKET) -> DataFrame:
    """Adds the order value of the nearest row before (or after) for which ``present`` holds; the row itself counts."""
    sign = -1 if forward else 1
    at = df.withColumns({"_v": F.when(present, F.col(order)), "_o": F.col(order) * sign}).withColumn("_b", F.expr(f"floor(_o / {size})"))
    pick = F.max if not forward else F.min
    inside = pick("_v").over(Window.partitionBy("_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0))
    ends = at.groupBy("_b").agg(pick("_v").alias("_t"))
    before = pick("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(F.col("_b").alias("_cb"), before.alias("_c"))
    join = at.withColumn("_i", inside).join(carried, F.col("_b") == F.col("_cb"))
    return join.withColumn(name, F.coalesce("_i", "_c")).drop("_v", "_o", "_b", "_cb", "_c", "_i")
