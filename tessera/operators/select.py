"""Projections, type conversion and row filters.

All of these are narrow transformations: Catalyst keeps them in one
whole-stage-codegen span and pushes comparisons on raw columns into the
Parquet scan.  Filters compare the typed column (never its text form) so
pushdown survives.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal, InvalidOperation
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import is_numeric, named, null_safe_clip, try_number, zscore
from tessera.operators.profile import stats_row


def select_features(df: DataFrame, features: Sequence[str] | None = None,
                    target: str | None = None) -> DataFrame:
    """Features + target.  Defaults: target = first column, features =
    the next three columns."""
    cols = df.columns
    target = target or cols[0]
    if features is None:
        features = [c for c in cols if c != target][:3]
    missing = [c for c in [*features, target] if c not in cols]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    return df.select(*map(named, [*features, target]))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop named columns."""
    return df.drop(*cols)


def columns_with_missing(df: DataFrame) -> list[str]:
    """Names of columns holding at least one NULL (one aggregate, one row
    to the driver)."""
    row = df.agg(*[F.max(named(c).isNull().cast("int")).alias(f"m{i}")
                   for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row and row[f"m{i}"] == 1]


def drop_missing_columns(df: DataFrame) -> DataFrame:
    """Drop every column that has a missing value."""
    return df.drop(*columns_with_missing(df))


def to_numeric(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """P5: parse to double; anything that is not a number becomes NULL."""
    return df.withColumn(out or col, try_number(col))


def to_string(df: DataFrame, col: str, null_text: str | None = None,
              out: str | None = None) -> DataFrame:
    """Text form.  NULL stays NULL unless ``null_text`` is given (the
    original application produced the text ``nan``)."""
    s = named(col).cast("string")
    if null_text is not None:
        s = F.coalesce(s, F.lit(null_text))
    return df.withColumn(out or col, s)


def _exact_literal(text: str, dt: T.DataType):
    """The typed number as a literal of the column's type; None if no value of
    that type equals it."""
    try:
        number = Decimal(text)
    except InvalidOperation:
        return None
    if number.is_nan():
        return None
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.lit(float(number)).cast(dt)
    if number.is_infinite():
        return None
    if isinstance(dt, T.DecimalType):
        digits = number.normalize().as_tuple()
        whole = number == number.to_integral_value()
        fits = abs(number) < Decimal(10) ** 38 if whole else len(digits.digits) <= 38 and digits.exponent >= -38
        return F.lit(number) if fits else None
    bits = {"tinyint": 8, "smallint": 16, "int": 32}.get(dt.simpleString(), 64)
    if number != number.to_integral_value() or not -(2 ** (bits - 1)) <= number < 2 ** (bits - 1):
        return None
    return F.lit(int(number)).cast(dt)


def filter_exact(df: DataFrame, col: str, text: str | None) -> DataFrame:
    """keep rows whose value equals the typed text; empty text = no
    filter.  Numeric columns compare numbers in the column's own type, so
    ``7`` and ``7.0`` match 7, ``7.5`` matches no integer, and integers of any
    size match themselves only; the predicate reaches the Parquet scan.  NULL
    and NaN never match, and text that is no number matches nothing."""
    if text is None or text == "":
        return df
    dt = df.schema[col].dataType
    if is_numeric(dt):
        literal = _exact_literal(text.strip(), dt)
        return df.where(F.lit(False) if literal is None else named(col) == literal)
    if isinstance(dt, T.BooleanType):
        return df.where(named(col) == (text.strip().lower() == "true"))
    if isinstance(dt, T.StringType):
        return df.where(named(col) == F.lit(text))
    return df.where(named(col).cast("string") == F.lit(text))


def filter_range(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """inclusive numeric range; a missing bound is open (the column
    min/max in the original).  Non-numeric columns are not filtered."""
    if not is_numeric(df.schema[col].dataType):
        return df
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (named(col) >= F.lit(lo))
    if hi is not None:
        cond = cond & (named(col) <= F.lit(hi))
    return df.where(cond)


def filter_in(df: DataFrame, col: str, values: Sequence | DataFrame | None) -> DataFrame:
    """keep rows whose value is in ``values``; empty list = no filter.
    A DataFrame of values becomes a left-semi join (AQE picks broadcast
    when it is small)."""
    if values is None:
        return df
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(v, col, "left_semi")
    values = list(values)
    if not values:
        return df
    return df.where(named(col).isin(values))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """distinct non-NULL values (choices for F3)."""
    return df.select(named(col)).where(named(col).isNotNull()).distinct()


def drop_missing_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """drop rows with a NULL (or NaN) in any (or the given) column."""
    def there(c: str):
        known = named(c).isNotNull()
        return known & ~F.isnan(named(c)) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else known
    return df.where(reduce(and_, [there(c) for c in subset or df.columns], F.lit(True)))


def with_zscore(df: DataFrame, col: str, out: str = "z") -> DataFrame:
    """Add the z-score of ``col`` (sample std) from a broadcast stats row."""
    st = stats_row(df, [col], "__")
    return (df.crossJoin(F.broadcast(st))
            .withColumn(out, zscore(named(col).cast("double"), F.col("__mean_0"), F.col("__std_0")))
            .drop("__mean_0", "__std_0"))


def outlier_rows(df: DataFrame, col: str, k: float = 3.0) -> DataFrame:
    """rows with |z| > k."""
    return with_zscore(df, col, "__z").where(F.abs("__z") > k).drop("__z")


def remove_outliers(df: DataFrame, col: str, k: float = 3.0, keep_null: bool = False) -> DataFrame:
    """C4: keep |z| <= k.  Rows whose value (hence z) is NULL are dropped too,
    as the comparison is not true; ``keep_null=True`` keeps them."""
    cond = F.abs("__z") <= k
    if keep_null:
        cond = cond | F.col("__z").isNull()
    return with_zscore(df, col, "__z").where(cond).drop("__z")


def cap_outliers(df: DataFrame, col: str, k: float = 3.0) -> DataFrame:
    """Clip to mean ± k·std; NULL stays NULL."""
    st = stats_row(df, [col], "__")
    m, s = F.col("__mean_0"), F.col("__std_0")
    x = named(col).cast("double")
    return (df.crossJoin(F.broadcast(st))
            .withColumn(col, null_safe_clip(x, m - k * s, m + k * s))
            .drop("__mean_0", "__std_0"))


def outlier_summary(df: DataFrame, col: str, k: float = 3.0) -> DataFrame:
    """One row ``(column, outliers)``."""
    return outlier_rows(df, col, k).agg(F.count(F.lit(1)).alias("outliers")) \
        .select(F.lit(col).alias("column"), "outliers")


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """First ``n`` rows in ``order_by`` order (TakeOrderedAndProject —
    each task keeps n rows, never a full sort)."""
    if order_by is None:
        return df.limit(n)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """S3: one row ``(rows, cols)``."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("cols"))
