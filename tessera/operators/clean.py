"""Cleaning steps.

Statistics (means, modes, medians, min/max) are computed by one aggregate
and joined back as a broadcast one-row DataFrame, so each step stays a lazy
projection that Catalyst fuses with its neighbours.  Only dictionaries of
one-hot encoding reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import categorical_columns, named, null_safe_clip, numeric_columns
from tessera.functions.ordering import dense_index
from tessera.functions.quantiles import exact_quantiles
from tessera.operators.profile import modes
from tessera.operators.select import columns_with_missing
from tessera.session import ensure_checkpoint_dir

#: Bytes of a dictionary that is sent to the rows instead of joined by shuffle.
DICTIONARY = 8 << 20


def _cols_or_missing(df: DataFrame, cols: Sequence[str] | None, numeric: bool) -> list[str]:
    if cols is not None:
        return list(cols)
    pool = numeric_columns(df) if numeric else categorical_columns(df)
    holes = set(columns_with_missing(df.select(*map(named, pool)))) if pool else set()
    return [c for c in pool if c in holes]


def impute_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL → column mean.  Default columns: numeric columns with a
    hole.  Imputed columns become double (as a hole makes them float)."""
    cols = _cols_or_missing(df, cols, numeric=True)
    if not cols:
        return df
    st = df.agg(*[F.avg(named(c).cast("double")).alias(f"__fill_{i}") for i, c in enumerate(cols)])
    out = df.crossJoin(F.broadcast(st))
    for i, c in enumerate(cols):
        out = out.withColumn(c, F.coalesce(named(c).cast("double"), F.col(f"__fill_{i}")))
    return out.drop(*[f"__fill_{i}" for i in range(len(cols))])


def impute_median(df: DataFrame, cols: Sequence[str] | None = None,
                  approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Y2: NULL → median (exact, linearly interpolated, computed without
    gathering a column in one task — ``functions.quantiles``; or the
    bounded-memory ``percentile_approx`` sketch with ``approx=True``)."""
    cols = _cols_or_missing(df, cols, numeric=True)
    if not cols:
        return df
    if approx:
        st = df.agg(*[F.percentile_approx(named(c).cast("double"), 0.5, accuracy).alias(f"__fill_{i}")
                      for i, c in enumerate(cols)])
    else:
        stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), named(c).cast("double").alias("v"))
                                                for i, c in enumerate(cols)])).alias("r")).select("r.*")
        med = exact_quantiles(stacked, "v", [0.5], ["i"], ["m"])
        st = med.agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"__fill_{i}") for i in range(len(cols))])
    out = df.crossJoin(F.broadcast(st))
    for i, c in enumerate(cols):
        out = out.withColumn(c, F.coalesce(named(c).cast("double"), F.col(f"__fill_{i}")))
    return out.drop(*[f"__fill_{i}" for i in range(len(cols))])


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL → most frequent value (smallest on ties), all columns' modes
    in one job.  A column with only NULLs stays NULL."""
    cols = _cols_or_missing(df, cols, numeric=False)
    if not cols:
        return df
    m = modes(df, cols)
    wide = m.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"__fill_{i}")
                   for i, c in enumerate(cols)])
    out = df.crossJoin(F.broadcast(wide))
    for i, c in enumerate(cols):
        out = out.withColumn(c, F.coalesce(named(c), F.col(f"__fill_{i}").cast(df.schema[c].dataType)))
    return out.drop(*[f"__fill_{i}" for i in range(len(cols))])


def impute_mean_mode(df: DataFrame) -> DataFrame:
    """Wizard step 1 'Mean/Mode Imputation': numeric holes → mean, others →
    mode, only columns with a hole."""
    holes = set(columns_with_missing(df))
    num = [c for c in numeric_columns(df) if c in holes]
    other = [c for c in df.columns if c in holes and c not in num]
    out = impute_mean(df, num) if num else df
    return impute_mode(out, other) if other else out


def label_encode(df: DataFrame, cols: Sequence[str] | None = None, suffix: str = "") -> DataFrame:
    """code = rank of the value among the sorted distinct values, NULL →
    -1.  The dictionary is built by a range-partitioned sort (no one-task
    window) and kept in a checkpoint, so that its size is known: one of at most
    ``DICTIONARY`` bytes goes to the rows (a frequent value would send its rows
    to one task), a larger one is joined by shuffle."""
    cols = list(cols) if cols is not None else categorical_columns(df)
    ensure_checkpoint_dir(df.sparkSession)
    out = df
    for c in cols:
        d = dense_index(df, c, "__code").withColumnRenamed(c, "__key").checkpoint()
        size = d.agg(F.sum(F.octet_length(F.col("__key").cast("string")) + 64)).first()[0] or 0
        out = (out.join(F.broadcast(d) if size <= DICTIONARY else d, on=named(c) == F.col("__key"), how="left")
               .withColumn(c + suffix, F.coalesce(F.col("__code"), F.lit(-1)).cast("int"))
               .drop("__code", "__key"))
    return out


def to_categorical(df: DataFrame, col: str) -> DataFrame:
    """Keep the text and add its dictionary code as ``<col>_code``."""
    return label_encode(df, [col], suffix="_code")


def one_hot(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace each text column with one boolean column per sorted value,
    named ``<col>_<value>``; a NULL row is all false.

    The values become columns, so the driver holds them like any schema; they
    are gathered in one job (stacked ``(column, value)`` pairs, deduplicated
    by a shuffle).  ``label_encode`` has no such table of values and suits
    columns with very many.
    """
    cols = list(cols) if cols is not None else categorical_columns(df)
    if not cols:
        return df
    pairs = (df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), named(c).cast("string").alias("v"))
                                            for i, c in enumerate(cols)])).alias("r"))
             .select("r.*").where(F.col("v").isNotNull()).distinct().collect())
    values: dict[int, list[str]] = {i: [] for i in range(len(cols))}
    for r in pairs:
        values[r["i"]].append(r["v"])
    new_cols = []
    for i, c in enumerate(cols):
        vals = sorted(values[i])
        new_cols += [F.coalesce(named(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for v in vals]
    keep = [named(c) for c in df.columns if c not in cols]
    return df.select(*keep, *new_cols)


def log_transform(df: DataFrame, col: str) -> DataFrame:
    """log(1 + max(x, 0)); NULL stays NULL."""
    x = named(col).cast("double")
    return df.withColumn(col, F.log1p(null_safe_clip(x, lo=F.lit(0.0))))


def standard_scale(df: DataFrame, col: str) -> DataFrame:
    """(x - mean) / sample std; a constant column gives NULL."""
    x = named(col).cast("double")
    st = df.agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    return (df.crossJoin(F.broadcast(st))
            .withColumn(col, F.try_divide(x - F.col("__m"), F.col("__s")))
            .drop("__m", "__s"))


def minmax_scale(df: DataFrame, col: str) -> DataFrame:
    """C11: (x - min) / (max - min); a constant column gives NULL."""
    x = named(col).cast("double")
    st = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    return (df.crossJoin(F.broadcast(st))
            .withColumn(col, F.try_divide(x - F.col("__lo"), F.col("__hi") - F.col("__lo")))
            .drop("__lo", "__hi"))


def iqr_fences(df: DataFrame, col: str, by: str | None = None, k: float = 1.5,
               approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Quartiles and fences per group: ``(by?, q1, q3, lo_fence, hi_fence)``."""
    x = named(col).cast("double")
    keys = [by] if by else []
    g = df.where(x.isNotNull())
    if approx:
        q = F.percentile_approx(x, [0.25, 0.75], accuracy)
        g = g.groupBy(by).agg(q.alias("__q")) if by else g.agg(q.alias("__q"))
        g = g.select(*keys, F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("q3"))
    else:
        g = exact_quantiles(g, x, [0.25, 0.75], keys, ["q1", "q3"])
    q1, q3 = F.col("q1"), F.col("q3")
    return g.select(*keys, q1.alias("q1"), q3.alias("q3"),
                    (q1 - k * (q3 - q1)).alias("lo_fence"), (q3 + k * (q3 - q1)).alias("hi_fence"))


def iqr_outliers(df: DataFrame, col: str, by: str | None = None, k: float = 1.5,
                 approx: bool = False) -> DataFrame:
    """Rows strictly outside the 1.5·IQR fences (of their group)."""
    f = iqr_fences(df, col, by, k, approx).drop("q1", "q3")
    x = named(col).cast("double")
    joined = df.join(f, by) if by else df.crossJoin(F.broadcast(f))
    return joined.where((x < F.col("lo_fence")) | (x > F.col("hi_fence"))).drop("lo_fence", "hi_fence")


def cast_types(df: DataFrame, mapping: dict[str, T.DataType | str]) -> DataFrame:
    """Explicit casts (used by plans); unparsable values raise under ANSI."""
    out = df
    for c, t in mapping.items():
        out = out.withColumn(c, named(c).cast(t))
    return out
