"""Column profiles and table-wide summaries.

All per-column figures come from **one** aggregate over the table (map-side
partial aggregation, one tiny shuffle), then a one-row → p-row ``explode``
into long form, so the cost is one scan regardless of the column count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import dtype_name, is_numeric, named, numeric_columns, spread, zscore

# Advice lines of the recommendation report, as worded in the
# application this library re-implements.
ADVICE_MISSING = "Impute or drop columns with missing values."
ADVICE_CORRELATED = "Remove or combine highly correlated features."
ADVICE_ONE_HOT = "Consider one-hot encoding for categorical columns with few unique values."
ADVICE_CLASSIFICATION = "Recommended: Classification models (Logistic Regression, Random Forest, etc.)"
ADVICE_REGRESSION = "Recommended: Regression models (Linear Regression, Random Forest, etc.)"


def _distinct(c: str, approx: bool, rsd: float) -> Column:
    return F.approx_count_distinct(named(c), rsd) if approx else F.count_distinct(named(c))


def _explode_rows(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def missing_counts(df: DataFrame) -> DataFrame:
    """G1: ``(position, column, missing)`` — NULL count per column."""
    cols = df.columns
    agg = df.agg(*[F.count_if(named(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    return _explode_rows(agg, [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.col(f"m{i}").cast("bigint").alias("missing"))
        for i, c in enumerate(cols)])


def missing_pct(df: DataFrame) -> DataFrame:
    """``(position, column, missing, missing_pct)``; pct is NULL on an
    empty table."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(named(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    return _explode_rows(agg, [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.col(f"m{i}").cast("bigint").alias("missing"),
                 F.try_divide(F.col(f"m{i}") * 100.0, F.col("n")).alias("missing_pct"))
        for i, c in enumerate(cols)])


def unique_counts(df: DataFrame, approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """``(position, column, unique)`` distinct non-NULL values.

    Exact distinct over p columns in one aggregate expands rows p times;
    ``approx=True`` uses HyperLogLog++ sketches (bounded memory, one pass,
    relative error ``rsd``; Spark's default 0.05 keeps the aggregate buffer
    small enough for code generation) and is the setting for large tables.
    """
    cols = df.columns
    if not approx:
        df = spread(df)
    agg = df.agg(*[_distinct(c, approx, rsd).alias(f"u{i}") for i, c in enumerate(cols)])
    return _explode_rows(agg, [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.col(f"u{i}").cast("bigint").alias("unique"))
        for i, c in enumerate(cols)])


def column_profile(df: DataFrame, approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """G4 (flagship): ``(position, column, dtype, missing, missing_pct, unique)``.

    One fused aggregate computes row count, non-NULL count and distinct
    count of every column; types come from the schema (no job).
    """
    fields = df.schema.fields
    if not approx:
        # exact distinct expands every row once per column: spread a
        # single-split scan first so the expanded rows use every task slot
        df = spread(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        aggs.append(F.count(named(f.name)).alias(f"nn{i}"))
        aggs.append(_distinct(f.name, approx, rsd).alias(f"u{i}"))
    agg = df.agg(*aggs)
    return _explode_rows(agg, [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(dtype_name(f.dataType)).alias("dtype"),
                 (F.col("n") - F.col(f"nn{i}")).cast("bigint").alias("missing"),
                 F.try_divide((F.col("n") - F.col(f"nn{i}")) * 100.0, F.col("n")).alias("missing_pct"),
                 F.col(f"u{i}").cast("bigint").alias("unique"))
        for i, f in enumerate(fields)])


def stats_row(df: DataFrame, cols: Sequence[str], prefix: str = "") -> DataFrame:
    """One-row DataFrame: ``{prefix}mean_i, {prefix}std_i`` (sample std) per
    column index.  Joined back with ``crossJoin(broadcast(...))`` — one row,
    so the broadcast size is fixed."""
    aggs = []
    for i, c in enumerate(cols):
        x = named(c).cast("double")
        aggs += [F.avg(x).alias(f"{prefix}mean_{i}"), F.stddev_samp(x).alias(f"{prefix}std_{i}")]
    return df.agg(*aggs)


def column_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(position, column, count, mean, std, min, max)`` in one pass;
    std is the sample standard deviation (ddof = 1)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = named(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    agg = df.agg(*aggs)
    return _explode_rows(agg, [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.col(f"n{i}").alias("count"), F.col(f"a{i}").alias("mean"),
                 F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
                 F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)])


def _top_by_count(counts: DataFrame, key: str | None, value: str, n: str) -> DataFrame:
    """Most frequent value per key, smallest value on ties, by a min over
    ``struct(-count, value)`` — a partial/final aggregate, no sort."""
    best = F.min(F.struct((-named(n)).alias("neg"), named(value).alias("v"))).alias("b")
    g = counts.groupBy(key).agg(best) if key else counts.agg(best)
    sel = [key] if key else []
    return g.select(*sel, F.col("b.v").alias("mode"), (-F.col("b.neg")).cast("bigint").alias("count"))


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """``(column, mode, count)`` — most frequent non-NULL value, the
    smallest on ties.  ``groupBy(value)`` first (map-side combined, so one
    hot value costs one partial row per partition)."""
    counts = df.where(named(col).isNotNull()).groupBy(named(col)).agg(F.count(F.lit(1)).alias("n"))
    return _top_by_count(counts, None, col, "n").select(F.lit(col).alias("column"), "mode", "count")


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Modes of several columns in one job: ``(column, mode, count)`` with the
    mode as text (columns are stacked into one ``(column, value)`` stream)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in cols
    ])).alias("r")).select("r.*").where(F.col("value").isNotNull())
    counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return _top_by_count(counts, "column", "value", "n")


def group_agg(df: DataFrame, x: str, y: str, fn: str = "mean") -> DataFrame:
    """G7 bar-chart data: ``(x, y)`` per non-NULL ``x``.

    ``mean`` of only-NULL y is NULL, ``sum`` of only-NULL y is 0, ``count``
    counts non-NULL y; ``none`` returns the rows unaggregated.
    """
    if not is_numeric(df.schema[y].dataType, include_bool=True):
        raise TypeError(f"y column {y!r} must be numeric for a bar chart")
    base = df.select(named(x), named(y)).where(named(x).isNotNull())
    if fn == "none":
        return base
    yv = named(y).cast("double") if isinstance(df.schema[y].dataType, T.BooleanType) else named(y)
    agg = {"mean": F.avg(yv),
           "sum": F.coalesce(F.sum(yv), F.lit(0)),
           "count": F.count(yv)}.get(fn)
    if agg is None:
        raise ValueError(f"unknown aggregation {fn!r}")
    return base.groupBy(named(x)).agg(agg.alias(y))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """G8 pie data: ``(col, count, pct)``, most frequent first (ties by value);
    pct is the share of non-NULL rows.  The total comes from a one-row
    aggregate joined by broadcast, not from an unpartitioned window."""
    counts = df.where(named(col).isNotNull()).groupBy(named(col)).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("__total"))
    return (counts.crossJoin(F.broadcast(total))
            .select(named(col), "count", (F.col("count") * 100.0 / F.col("__total")).alias("pct"))
            .orderBy(F.desc("count"), F.asc(col)))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation for every ordered pair of numeric (and
    boolean, as 0/1) columns, pairwise-complete rows: ``(col_a, col_b, corr)``.

    Two passes of plain sums (codegen-friendly; the built-in ``corr``
    carries a six-field buffer per pair, which pushes wide aggregates out of
    whole-stage codegen): pass 1 gives each column's mean and NULL count
    (2p numbers reach the driver); pass 2 sums centred cross products.  When
    no column has a NULL, the p(p+1)/2 centred sums are shared by all pairs;
    otherwise every pair sums over its own complete rows.
    """
    cols = list(cols) if cols is not None else numeric_columns(df, include_bool=True)
    if not cols:
        raise ValueError("no numeric columns to correlate")
    x = [named(c).cast("double") for c in cols]
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)],
                   *[F.count(v).alias(f"c{i}") for i, v in enumerate(x)]).first()
    means = [first[f"m{i}"] if first[f"m{i}"] is not None else 0.0 for i in range(len(cols))]
    has_null = any(first[f"c{i}"] != first["n"] for i in range(len(cols)))
    dx = [v - F.lit(m) for v, m in zip(x, means)]
    aggs = []
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    if not has_null:
        for i, j in pairs:
            aggs.append(F.sum(dx[i] * dx[j]).alias(f"s{i}_{j}"))
        sums = df.agg(*aggs)

        def corr_expr(i, j):
            return F.try_divide(F.col(f"s{i}_{j}"), F.sqrt(F.col(f"s{i}_{i}") * F.col(f"s{j}_{j}")))
    else:
        for i, j in pairs:
            both = x[i].isNotNull() & x[j].isNotNull()
            a_, b_ = F.when(both, dx[i]), F.when(both, dx[j])
            aggs += [F.count(a_).alias(f"n{i}_{j}"), F.sum(a_).alias(f"a{i}_{j}"), F.sum(b_).alias(f"b{i}_{j}"),
                     F.sum(a_ * a_).alias(f"aa{i}_{j}"), F.sum(b_ * b_).alias(f"bb{i}_{j}"),
                     F.sum(a_ * b_).alias(f"ab{i}_{j}")]
        sums = df.agg(*aggs)

        def corr_expr(i, j):
            n = F.col(f"n{i}_{j}")
            sab = F.col(f"ab{i}_{j}") - F.col(f"a{i}_{j}") * F.col(f"b{i}_{j}") / n
            saa = F.col(f"aa{i}_{j}") - F.col(f"a{i}_{j}") * F.col(f"a{i}_{j}") / n
            sbb = F.col(f"bb{i}_{j}") - F.col(f"b{i}_{j}") * F.col(f"b{i}_{j}") / n
            return F.when(n > 1, F.try_divide(sab, F.sqrt(saa * sbb)))
    structs = []
    for i, j in pairs:
        c = corr_expr(i, j)
        c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        structs.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"), c.alias("corr")))
        if i != j:
            structs.append(F.struct(F.lit(cols[j]).alias("col_a"), F.lit(cols[i]).alias("col_b"),
                                    c.alias("corr")))
    return _explode_rows(sums, structs)


def high_corr_pairs(df: DataFrame, threshold: float = 0.8,
                    cols: Sequence[str] | None = None) -> DataFrame:
    """Unordered pairs (col_a before col_b in column order) with
    ``|corr| > threshold``; ``exact`` flags |corr| = 1 (duplicated signals
    are reported, not hidden)."""
    cols = list(cols) if cols is not None else numeric_columns(df, include_bool=True)
    order = {c: i for i, c in enumerate(cols)}
    pos = F.create_map(*[v for c, i in order.items() for v in (F.lit(c), F.lit(i))])
    m = correlation_matrix(df, cols)
    return (m.where((pos[F.col("col_a")] < pos[F.col("col_b")]) & (F.abs("corr") > threshold))
            .select("col_a", "col_b", "corr", (F.abs("corr") >= 1.0).alias("exact")))


def outlier_counts(df: DataFrame, k: float = 3.0, cols: Sequence[str] | None = None) -> DataFrame:
    """``(position, column, outliers)`` rows with |z| > k per numeric
    column.  Two jobs in total: one stats row, then one counting pass."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    st = stats_row(df, cols, "__")
    joined = df.select(*map(named, cols)).crossJoin(F.broadcast(st))
    agg = joined.agg(*[
        F.count_if(F.abs(zscore(named(c).cast("double"), F.col(f"__mean_{i}"), F.col(f"__std_{i}"))) > k)
        .alias(f"o{i}") for i, c in enumerate(cols)])
    return _explode_rows(agg, [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.col(f"o{i}").cast("bigint").alias("outliers"))
        for i, c in enumerate(cols)])


def low_cardinality(df: DataFrame, threshold: int = 5, approx: bool = False) -> DataFrame:
    """``(position, column, unique, low_cardinality)`` — flags columns
    with fewer than ``threshold`` distinct values (reuses G3)."""
    u = unique_counts(df, approx=approx)
    return u.withColumn("low_cardinality", F.col("unique") < threshold)


def detect_task(df: DataFrame, target: str, threshold: int = 10) -> DataFrame:
    """One row ``(target, distinct_seen, task)``; text targets or fewer than
    ``threshold`` distinct values mean classification.

    The distinct count stops early: it counts at most ``threshold`` distinct
    values (``distinct().limit``), enough to decide.
    """
    is_text = isinstance(df.schema[target].dataType, T.StringType)
    d = (df.select(named(target)).where(named(target).isNotNull()).distinct()
         .limit(threshold).agg(F.count(F.lit(1)).alias("distinct_seen")))
    task = F.lit("classification") if is_text else \
        F.when(F.col("distinct_seen") < threshold, "classification").otherwise("regression")
    return d.select(F.lit(target).alias("target"), F.col("distinct_seen").cast("bigint"), task.alias("task"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """``(label, count)`` rows per class, NULL label excluded."""
    return df.where(named(label).isNotNull()).groupBy(named(label)).agg(F.count(F.lit(1)).alias("count"))


def max_folds(df: DataFrame, label: str, folds: int = 3) -> int:
    """Cross-validation folds allowed by the smallest class: min(folds,
    smallest); raises below 2.  Collects one number."""
    smallest = class_counts(df, label).agg(F.min("count")).first()[0]
    if smallest is None or smallest < 2:
        raise ValueError("each class needs at least 2 training rows for cross-validation")
    return int(min(folds, smallest))


def recommendations(df: DataFrame, target: str | None = None,
                    corr_threshold: float = 0.8, low_card: int = 5,
                    approx: bool = False) -> DataFrame:
    """Advice rows ``(rule, detail)`` from missing counts, correlated
    pairs, low-cardinality columns and (with a target) the task type.

    Built only from the long-form outputs of G1, G10, G12 and G20, combined
    with small aggregates; nothing is collected.
    """
    miss = missing_counts(df).agg(F.sum("missing").alias("v"))
    rows = [miss.where(F.col("v") > 0).select(F.lit("missing").alias("rule"),
                                              F.lit(ADVICE_MISSING).alias("detail"))]
    if numeric_columns(df, include_bool=True):
        hc = high_corr_pairs(df, corr_threshold).agg(F.count(F.lit(1)).alias("v"))
        rows.append(hc.where(F.col("v") > 0).select(F.lit("correlated").alias("rule"),
                                                    F.lit(ADVICE_CORRELATED).alias("detail")))
    lc = low_cardinality(df, low_card, approx).agg(F.count_if("low_cardinality").alias("v"))
    rows.append(lc.where(F.col("v") > 0).select(F.lit("one_hot").alias("rule"),
                                                F.lit(ADVICE_ONE_HOT).alias("detail")))
    if target:
        t = detect_task(df, target)
        rows.append(t.select(F.lit("model_type").alias("rule"),
                             F.when(F.col("task") == "classification", ADVICE_CLASSIFICATION)
                             .otherwise(ADVICE_REGRESSION).alias("detail")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
