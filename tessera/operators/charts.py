"""Chart-ready aggregates.

Outputs are bounded by the number of groups × bins × grid points, never by
the row count, so a chart of 100 TB of rows is still a small table.  The
bin edges and bandwidths come from one stats aggregate; where that decision
must be made on the driver (``bins="auto"``) only a handful of numbers are
collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.quantiles import exact_quantiles
from tessera.operators.clean import iqr_fences

SQRT_2PI = math.sqrt(2 * math.pi)


def _x(col: str) -> Column:
    return F.col(col).cast("double")


# --- G13 box -------------------------------------------------------------

def box_stats(df: DataFrame, y: str, by: str | None = None, k: float = 1.5,
              approx: bool = False) -> DataFrame:
    """Per group ``q1, median, q3, iqr, whisker_lo, whisker_hi, n,
    n_outliers``.  Whiskers are the extreme data points inside the 1.5·IQR
    fences; outliers lie strictly outside.

    Pass 1: quartiles per group (exact: ``functions.quantiles`` — spread
    over range partitions, no group gathered in one task; ``approx=True``:
    the bounded GK sketch in one aggregate).  Pass 2: the per-group fences
    join back to the rows for whiskers and outlier counts.
    """
    x = _x(y)
    keys = [by] if by else []
    base = df.where(x.isNotNull())
    if approx:
        q = F.percentile_approx(x, [0.25, 0.5, 0.75], 10000)
        quart = (base.groupBy(*keys) if keys else base.groupBy()).agg(q.alias("__q"))
        quart = quart.select(*keys, F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"),
                             F.col("__q")[2].alias("q3"))
    else:
        quart = exact_quantiles(base, x, [0.25, 0.5, 0.75], keys, ["q1", "median", "q3"])
    lo = F.col("q1") - k * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + k * (F.col("q3") - F.col("q1"))
    joined = base.join(quart, by) if by else base.crossJoin(F.broadcast(quart))
    inside = (x >= lo) & (x <= hi)
    agg = (joined.groupBy(*keys, "q1", "median", "q3") if keys
           else joined.groupBy("q1", "median", "q3"))
    return agg.agg(
        F.min(F.when(inside, x)).alias("whisker_lo"),
        F.max(F.when(inside, x)).alias("whisker_hi"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(~inside).alias("n_outliers"),
    ).withColumn("iqr", F.col("q3") - F.col("q1"))


# --- G14 histogram -------------------------------------------------------

def auto_bins(n: int, lo: float, hi: float, q1: float, q3: float) -> int:
    """numpy-style 'auto': the smaller width of Sturges and Freedman-Diaconis
    (Sturges alone when the IQR is 0)."""
    span = hi - lo
    if n <= 1 or span <= 0:
        return 1
    sturges = span / (math.log2(n) + 1.0)
    iqr = q3 - q1
    width = min(sturges, 2.0 * iqr * n ** (-1.0 / 3.0)) if iqr > 0 else sturges
    return max(1, int(math.ceil(span / width)))


def histogram(df: DataFrame, col: str, bins: int | str = 20) -> DataFrame:
    """``(bin, lo, hi, count)`` equal-width bins over non-NULL values;
    the last bin is closed on the right; empty bins are kept.

    With a fixed bin count the plan is fully lazy (stats row broadcast);
    ``bins="auto"`` first collects n, min, max and quartiles (5 numbers).
    """
    x = _x(col)
    base = df.where(x.isNotNull())
    if bins == "auto":
        r = base.agg(F.count(F.lit(1)), F.min(x), F.max(x),
                     F.percentile_approx(x, [0.25, 0.75], 10000)).first()
        if not r or not r[0]:
            return _empty_hist(df)
        nb = auto_bins(r[0], r[1], r[2], r[3][0], r[3][1])
    else:
        nb = int(bins)
    st = base.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    w = (F.col("__hi") - F.col("__lo")) / nb
    b = F.least(F.floor(F.try_divide(x - F.col("__lo"), w)), F.lit(nb - 1))
    b = F.coalesce(b, F.lit(0)).cast("int")  # zero width: everything in bin 0
    counts = base.crossJoin(F.broadcast(st)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(nb).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(st))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.col("__lo") + F.col("bin") * w).alias("lo"),
                    (F.col("__lo") + (F.col("bin") + 1) * w).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def _empty_hist(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count bigint")


# --- G15 / G16 density ---------------------------------------------------

def kde(df: DataFrame, col: str, by: str | None = None, grid: int = 200,
        method: str = "exact", fine_bins: int = 2048) -> DataFrame:
    """Gaussian kernel density on a grid of ``grid`` points from
    min - 3h to max + 3h per group, h = std · n^(-1/5) (Scott).

    ``exact`` sums over every row against a broadcast grid (rows × grid
    kernel evaluations, map-side combined, so the shuffle is grid-sized);
    ``binned`` first reduces the rows to ``fine_bins`` weighted bin centres
    per group, making the cost independent of the row count (error below
    the bin width relative to h).
    Output ``(by?, point, y, density)``.
    """
    x = _x(col)
    keys = [by] if by else []
    base = df.where(x.isNotNull()).select(*keys, x.alias("__x"))
    gstats = (base.groupBy(*keys) if keys else base.groupBy()).agg(
        F.count(F.lit(1)).alias("__n"), F.stddev_samp("__x").alias("__sd"),
        F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    gstats = gstats.withColumn("__h", F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
    gstats = gstats.withColumn("__start", F.col("__lo") - 3 * F.col("__h")) \
                   .withColumn("__step", (F.col("__hi") - F.col("__lo") + 6 * F.col("__h")) / (grid - 1))
    pts = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("point"))
    gridded = gstats.crossJoin(F.broadcast(pts)) \
        .withColumn("y", F.col("__start") + F.col("point") * F.col("__step"))
    if method == "binned":
        bw = (F.col("__hi") - F.col("__lo")) / fine_bins
        fb = F.coalesce(F.least(F.floor(F.try_divide(F.col("__x") - F.col("__lo"), bw)),
                                F.lit(fine_bins - 1)), F.lit(0))
        # one row per group: AQE broadcasts it when small (no size is proven)
        jb = base.join(gstats.select(*keys, "__lo", "__hi"), keys) if keys \
            else base.crossJoin(F.broadcast(gstats.select("__lo", "__hi")))
        base = (jb.groupBy(*keys, fb.alias("__b"))
                .agg(F.count(F.lit(1)).alias("__w"), F.avg("__x").alias("__x")))
    else:
        base = base.withColumn("__w", F.lit(1))
    # Grid rows are groups × grid points: small, so AQE broadcasts them.
    pairs = base.join(gridded.select(*keys, "point", "y", "__h", "__n"), keys) if keys \
        else base.crossJoin(F.broadcast(gridded.select("point", "y", "__h", "__n")))
    u = F.try_divide(F.col("y") - F.col("__x"), F.col("__h"))  # constant column: h = 0 → NULL
    dens = (pairs.groupBy(*keys, "point", "y", "__h", "__n")
            .agg(F.sum(F.col("__w") * F.exp(-0.5 * u * u)).alias("__s")))
    return dens.select(*keys, "point", "y",
                       F.try_divide(F.col("__s"), F.col("__n") * F.col("__h") * F.lit(SQRT_2PI))
                       .alias("density"))


def violin_stats(df: DataFrame, y: str, by: str | None = None, grid: int = 100,
                 method: str = "exact") -> DataFrame:
    """Density curve per group joined with that group's box figures."""
    d = kde(df, y, by, grid, method)
    b = box_stats(df, y, by).select(*([by] if by else []), "q1", "median", "q3")
    return d.join(b, by) if by else d.crossJoin(F.broadcast(b))


# --- G17 / G18 scatter and pair grid ---------------------------------------

def scatter_bins(df: DataFrame, x: str, y: str, color: str | None = None,
                 bins: int = 50) -> DataFrame:
    """2-D binned scatter ``(bx, by, color?, x_lo, y_lo, count)`` — the
    point cloud reduced to at most bins² cells per colour."""
    xv, yv = _x(x), _x(y)
    base = df.where(xv.isNotNull() & yv.isNotNull())
    st = base.agg(F.min(xv).alias("__xl"), F.max(xv).alias("__xh"),
                  F.min(yv).alias("__yl"), F.max(yv).alias("__yh"))
    wx = (F.col("__xh") - F.col("__xl")) / bins
    wy = (F.col("__yh") - F.col("__yl")) / bins
    bx = F.coalesce(F.least(F.floor(F.try_divide(xv - F.col("__xl"), wx)), F.lit(bins - 1)), F.lit(0)).cast("int")
    by_ = F.coalesce(F.least(F.floor(F.try_divide(yv - F.col("__yl"), wy)), F.lit(bins - 1)), F.lit(0)).cast("int")
    keys = [bx.alias("bx"), by_.alias("by")] + ([F.col(color)] if color else [])
    g = base.crossJoin(F.broadcast(st)).groupBy(*keys, "__xl", "__yl", "__xh", "__yh") \
        .agg(F.count(F.lit(1)).alias("count"))
    return g.select("bx", "by", *([color] if color else []),
                    (F.col("__xl") + F.col("bx") * (F.col("__xh") - F.col("__xl")) / bins).alias("x_lo"),
                    (F.col("__yl") + F.col("by") * (F.col("__yh") - F.col("__yl")) / bins).alias("y_lo"),
                    "count")


def pair_grid(df: DataFrame, cols: Sequence[str], bins: int = 20) -> DataFrame:
    """For every ordered pair of columns the 2-D bin counts, and on the
    diagonal the 1-D histogram: ``(col_a, col_b, bin_a, bin_b, count)``.

    Each row is binned once per column, then exploded into p² pair cells and
    counted in one aggregate (partial aggregation keeps the shuffle at
    p²·bins² rows per task).  Rows with a NULL in a pair skip that pair.
    """
    cols = list(cols)
    st = df.agg(*[F.min(_x(c)).alias(f"__l{i}") for i, c in enumerate(cols)],
                *[F.max(_x(c)).alias(f"__h{i}") for i, c in enumerate(cols)])
    binned = df.crossJoin(F.broadcast(st)).select(*[
        F.coalesce(F.least(F.floor(F.try_divide(_x(c) - F.col(f"__l{i}"),
                                                (F.col(f"__h{i}") - F.col(f"__l{i}")) / bins)),
                           F.lit(bins - 1)),
                   F.when(_x(c).isNotNull(), F.lit(0))).cast("int").alias(f"b{i}")
        for i, c in enumerate(cols)])
    cells = F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.col(f"b{i}").alias("bin_a"), F.col(f"b{j}").alias("bin_b"))
        for i, a in enumerate(cols) for j, b in enumerate(cols)])
    ex = binned.select(F.explode(cells).alias("c")).select("c.*") \
        .where(F.col("bin_a").isNotNull() & F.col("bin_b").isNotNull())
    return ex.groupBy("col_a", "col_b", "bin_a", "bin_b").agg(F.count(F.lit(1)).alias("count"))


# --- G19 line --------------------------------------------------------------

def line_series(df: DataFrame, x: str | Column, y: str, z: float = 1.96,
                x_name: str | None = None) -> DataFrame:
    """Mean of y per x with a normal 95% interval
    ``(x, n, mean, lo, hi)``; order by x when drawing."""
    xc = F.col(x) if isinstance(x, str) else x
    name = x_name or (x if isinstance(x, str) else "x")
    yv = _x(y)
    g = df.where(xc.isNotNull()).groupBy(xc.alias(name)).agg(
        F.count(yv).alias("n"), F.avg(yv).alias("mean"), F.stddev_samp(yv).alias("__s"))
    half = F.try_divide(z * F.col("__s"), F.sqrt(F.col("n").cast("double")))
    return g.select(name, "n", "mean", (F.col("mean") - half).alias("lo"),
                    (F.col("mean") + half).alias("hi"))


def summary_stats(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """``(position, column, count, mean, std, min, q25, q50, q75, max)``
    for numeric columns: moments in one aggregate; quartiles of all columns
    in one stacked exact-quantile job (or sketches with ``approx=True``)."""
    aggs = []
    for i, c in enumerate(cols):
        x = _x(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        if approx:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"q{i}"))
    agg = df.agg(*aggs)
    moments = agg.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                 F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"),
                 F.col(f"h{i}").alias("max"),
                 *([F.col(f"q{i}")[0].alias("q25"), F.col(f"q{i}")[1].alias("q50"), F.col(f"q{i}")[2].alias("q75")]
                   if approx else []))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")
    if not approx:
        stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), _x(c).alias("v"))
                                                for i, c in enumerate(cols)])).alias("r")).select("r.*")
        qs = exact_quantiles(stacked, "v", [0.25, 0.5, 0.75], ["position"], ["q25", "q50", "q75"])
        moments = moments.join(qs, "position", "left")
    return moments.select("position", "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


__all__ = ["box_stats", "histogram", "auto_bins", "kde", "violin_stats", "scatter_bins",
           "pair_grid", "line_series", "summary_stats", "iqr_fences"]
