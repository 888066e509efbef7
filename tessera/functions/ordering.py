"""Distributed global order without a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` moves every row to one
task.  The helpers here range-partition instead, compute running values
inside each range partition, and add per-partition offsets from a table
with one row per partition (its size is bounded by the partition count, so
broadcasting it is safe).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import named


def _order_cols(order_by: Sequence[str | Column], descending: bool) -> list[Column]:
    cols = [named(c) if isinstance(c, str) else c for c in order_by]
    return [c.desc() if descending else c.asc() for c in cols]


def running_sums(df: DataFrame, order_by: Sequence[str | Column],
                 value_cols: Sequence[str], descending: bool = False,
                 num_partitions: int | None = None,
                 inclusive: bool = True) -> DataFrame:
    """Add ``cum_<v>`` = running sum of each value column in global order.

    ``order_by`` must identify rows uniquely (as on aggregated tables), else
    ties are summed in arbitrary order.  ``inclusive=False`` gives the sum of
    rows strictly before the current one.
    """
    order = _order_cols(order_by, descending)
    parts = (df.repartitionByRange(num_partitions, *order) if num_partitions
             else df.repartitionByRange(*order))
    parts = parts.withColumn("__pid", F.spark_partition_id())
    w_local = Window.partitionBy("__pid").orderBy(*order)
    frame = (w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
             if inclusive else w_local.rowsBetween(Window.unboundedPreceding, -1))
    local = parts
    for v in value_cols:
        local = local.withColumn(f"__loc_{v}", F.coalesce(F.sum(v).over(frame), F.lit(0)))
    # One row per range partition: totals, then exclusive prefix over them.
    totals = parts.groupBy("__pid").agg(*[F.sum(v).alias(f"__tot_{v}") for v in value_cols])
    w_pid = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *[
        F.coalesce(F.sum(f"__tot_{v}").over(w_pid), F.lit(0)).alias(f"__off_{v}")
        for v in value_cols])
    out = local.join(F.broadcast(offsets), "__pid", "left")
    for v in value_cols:
        out = out.withColumn(f"cum_{v}", F.col(f"__loc_{v}") + F.coalesce(F.col(f"__off_{v}"), F.lit(0)))
    drop = ["__pid"] + [f"__loc_{v}" for v in value_cols] + [f"__off_{v}" for v in value_cols]
    return out.drop(*drop)


def dense_index(df: DataFrame, col: str, index_col: str = "code") -> DataFrame:
    """Distinct non-NULL values of ``col`` with their 0-based rank in
    ascending order (a sorted dictionary), computed without one-task sort."""
    d = df.select(named(col)).where(named(col).isNotNull()).distinct().withColumn("__one", F.lit(1))
    r = running_sums(d, [col], ["__one"], inclusive=False)
    return r.select(col, F.col("cum___one").cast("int").alias(index_col))
