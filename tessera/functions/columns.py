"""Schema helpers and JVM-side column expressions shared by operators.

Nothing here runs a job: the schema helpers read ``df.schema`` on the
driver, the expression helpers build ``Column`` objects that stay inside
whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text accepted as a number by ``to_numeric``: decimal or scientific forms,
# inf/nan, surrounding blanks.  Spark's cast alone would also take Java
# suffix forms such as '12d'.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def named(name: str) -> Column:
    """The column of exactly this name, with dots, blanks or quotes in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def is_numeric(dt: T.DataType, include_bool: bool = False) -> bool:
    if isinstance(dt, T.NumericType):
        return True
    return include_bool and isinstance(dt, T.BooleanType)


def numeric_columns(df: DataFrame, include_bool: bool = False,
                    exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order (P3).  Booleans only on request —
    the outlier and anomaly operators leave them out, correlation keeps them."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if f.name not in skip and is_numeric(f.dataType, include_bool)]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Text columns in schema order."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if f.name not in skip and isinstance(f.dataType, T.StringType)]


def as_double(c: str | Column) -> Column:
    col = named(c) if isinstance(c, str) else c
    return col.cast("double")


def try_number(c: str | Column) -> Column:
    """Text → double, anything unparsable and ``nan`` → NULL, the one mark of a
    missing value (never raises under ANSI)."""
    col = named(c) if isinstance(c, str) else c
    s = F.trim(col.cast("string"))
    number = F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))
    return F.when(~F.isnan(number), number)


def null_safe_clip(c: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """clip() that keeps NULL as NULL.  Spark's greatest/least skip NULL
    arguments (``greatest(NULL, 0) = 0``), so guard explicitly."""
    out = c
    if lo is not None:
        out = F.greatest(out, lo)
    if hi is not None:
        out = F.least(out, hi)
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def zscore(c: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; NULL when std is 0 or NULL (no ANSI error)."""
    return F.try_divide(c - mean, std)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (used to compare with SQL engines)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(named(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(named(f.name))
    return df.select(*cols)


def _has_shuffle(df: DataFrame) -> bool:
    """True when the physical plan contains an Exchange (planning only, no job)."""
    try:
        return "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    except Exception:  # unknown plan shape: do not probe
        return True


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """Before CPU-heavy per-row work: make sure a plain scan has at least as
    many partitions as task slots (a one-row-group file scans as a single
    task).  Inputs that already went through a shuffle, and large inputs,
    are returned unchanged — probing the partition count of a plan with an
    Exchange would run that stage early, so it is not done."""
    if _has_shuffle(df):
        return df
    target = df.sparkSession.sparkContext.defaultParallelism * factor
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
