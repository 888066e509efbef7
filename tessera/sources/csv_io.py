"""CSV source with whole-file type inference, and CSV sinks.

``read_table`` reads every field as text, turns missing-value tokens into
NULL, then decides each column's type with **one** aggregate over the file
(``count(try_cast(...)) = count(c)`` per candidate type) and applies the
casts in a lazy projection.  An explicit schema skips the inference pass.
Sinks write partitioned part files (no ``coalesce(1)``), so writing scales
with the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import NUMBER_PATTERN, named

# The default missing-value tokens of the pandas CSV reader.
DEFAULT_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

INT_PATTERN = r"^\s*[+-]?\d+\s*$"
BOOL_PATTERN = r"^(?i)(true|false)$"


class EmptyTableError(ValueError):
    """The file has no header or no columns."""


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "csv", na_tokens: Sequence[str] = DEFAULT_NA_TOKENS,
               infer: bool = True, multi_line: bool = False) -> DataFrame:
    """Read a table.

    * ``fmt="parquet"`` → ``spark.read.parquet`` (typed already).
    * CSV with ``schema`` → read with that schema, no inference pass.
    * CSV without schema → text read + one inference aggregate: a column is
      ``bigint`` if every non-missing value is an integer, else ``double`` if
      every value is a number, else ``boolean`` for true/false text, else
      ``string``.  A column with only missing values becomes ``double``.
      Dates stay text.

    A quote inside a quoted field is written twice.  ``multi_line`` accepts
    line breaks inside quoted fields; such a file cannot be split, so each
    file is read by one task.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.options(header=True, mode="PERMISSIVE", quote='"', escape='"', multiLine=multi_line)
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.option("inferSchema", False).csv(path)
    if not raw.columns:
        raise EmptyTableError(f"no columns found in {path}")
    tokens = list(na_tokens)
    cleaned = raw.select(*[
        F.when(named(c).isin(tokens), F.lit(None)).otherwise(named(c)).alias(c) for c in raw.columns])
    if not infer:
        return cleaned
    return cleaned.select(*[F.trim(named(c)).cast(t).alias(c) if t != "string" else named(c)
                            for c, t in infer_types(cleaned).items()])


def infer_types(df: DataFrame) -> dict[str, str]:
    """One aggregate over all text columns → Spark type name per column."""
    aggs = []
    for i, c in enumerate(df.columns):
        s = named(c)
        aggs += [F.count(s).alias(f"n{i}"),
                 F.count_if(s.rlike(INT_PATTERN) & s.try_cast("bigint").isNotNull()).alias(f"i{i}"),
                 F.count_if(s.rlike(NUMBER_PATTERN)).alias(f"d{i}"),
                 F.count_if(F.trim(s).rlike(BOOL_PATTERN)).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0:
            out[c] = "double"
        elif row[f"i{i}"] == n:
            out[c] = "bigint"
        elif row[f"d{i}"] == n:
            out[c] = "double"
        elif row[f"b{i}"] == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write as CSV with a header row (one part file per partition)."""
    df.write.mode(mode).options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                ignoreTrailingWhiteSpace=False).csv(path)
    return path


def write_leaderboard(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Leaderboards are small; same writer."""
    return write_csv(df, path, mode)


def write_chart_data(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """The (filtered) chart table; same writer."""
    return write_csv(df, path, mode)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
