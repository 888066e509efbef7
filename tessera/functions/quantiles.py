"""Exact quantiles without gathering a group into one task.

Spark's exact ``percentile`` keeps a value→count map per group; a group
holding a large share of the rows would need all its distinct values in one
task's memory.  Here the work is spread instead:

1. ``groupBy(group, value).count()`` — map-side combined;
2. running counts in global ``(group, value)`` order by range partitioning
   (a hot group spans many range partitions because its values differ);
3. each group's start offset and size from one aggregate of those counts;
4. every ``(group, value)`` row emits only the target ranks it covers
   (2 per probability), so at most groups × 2 × probabilities rows remain;
5. linear interpolation between the two ranks (the definition used by
   ``percentile`` and SQL ``quantile_cont``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import named

from tessera.functions.ordering import running_sums


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float],
                    by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """``(by..., q0, q1, ...)`` exact linearly interpolated quantiles of the
    non-NULL values per group (one row per group with at least one value)."""
    by = list(by)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    v = named(value) if isinstance(value, str) else value
    base = df.select(*by, v.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    vc = base.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    cum = running_sums(vc, [*by, "__v"], ["__c"])                       # inclusive, global order
    # a group's rows are contiguous in that order: its start offset is the
    # smallest exclusive running count, its size the largest inclusive one
    # minus the start (one aggregate, no second sort)
    span = (cum.groupBy(*by) if by else cum.groupBy()).agg(
        F.min(F.col("cum___c") - F.col("__c")).alias("__s"), F.max("cum___c").alias("__e"))
    start = span.select(*by, "__s", (F.col("__e") - F.col("__s")).alias("__n"))
    j = cum.join(start, by) if by else cum.crossJoin(F.broadcast(start))
    hi_k = F.col("cum___c") - F.col("__s")            # exclusive upper rank of this value
    lo_k = hi_k - F.col("__c")                        # first rank holding this value
    targets = []
    for i, p in enumerate(probs):
        pos = (F.col("__n") - 1) * F.lit(float(p))
        k0 = F.floor(pos)
        k1 = F.least(k0 + 1, F.col("__n") - 1)
        targets += [F.struct(F.lit(i).alias("qi"), F.lit(0).alias("side"), k0.alias("k"), (pos - k0).alias("frac")),
                    F.struct(F.lit(i).alias("qi"), F.lit(1).alias("side"), k1.alias("k"), (pos - k0).alias("frac"))]
    hits = j.select(*by, "__v", lo_k.alias("__lo"), hi_k.alias("__hi"), F.explode(F.array(*targets)).alias("t")) \
        .where((F.col("t.k") >= F.col("__lo")) & (F.col("t.k") < F.col("__hi"))) \
        .select(*by, "__v", "t.qi", "t.side", "t.frac")
    per_q = hits.groupBy(*by, "qi").agg(
        F.max(F.when(F.col("side") == 0, F.col("__v"))).alias("__v0"),
        F.max(F.when(F.col("side") == 1, F.col("__v"))).alias("__v1"),
        F.max("frac").alias("__f"))
    q = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.col("__f")
    wide = per_q.groupBy(*by).agg(*[F.max(F.when(F.col("qi") == i, q)).alias(n) for i, n in enumerate(names)])
    return wide
