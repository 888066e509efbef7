"""Report tables (S7, S8): several operator outputs in one long table.

A report is a ``unionByName`` of small long-form DataFrames with a common
schema ``(section, key1, key2, value, text)``; write it with
``write_report`` as JSON or CSV part files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import profile as G


def _rows(df: DataFrame, section: str, key1=None, key2=None, value=None, text=None) -> DataFrame:
    def c(x, t):
        if x is None:
            return F.lit(None).cast(t)
        return (F.col(x) if isinstance(x, str) else x).cast(t)
    return df.select(F.lit(section).alias("section"), c(key1, "string").alias("key1"),
                     c(key2, "string").alias("key2"), c(value, "double").alias("value"),
                     c(text, "string").alias("text"))


def eda_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """Missing counts per column, the correlation matrix and the advice
    lines, as ``(section, key1, key2, value, text)`` rows."""
    parts = [_rows(G.missing_counts(df), "missing", key1="column", value="missing")]
    from tessera.functions.columns import numeric_columns
    if numeric_columns(df, include_bool=True):
        parts.append(_rows(G.correlation_matrix(df), "correlation", key1="col_a", key2="col_b", value="corr"))
    parts.append(_rows(G.recommendations(df, target), "recommendation", key1="rule", text="detail"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explanation_report(shap_importance: DataFrame, permutation: DataFrame) -> DataFrame:
    """Mean |SHAP| per feature (and class) next to permutation
    importances, as ``(section, key1, key2, value, text)`` rows."""
    a = _rows(shap_importance, "shap", key1="feature", key2="class", value="mean_abs_shap")
    b = _rows(permutation, "permutation", key1="feature", value="importance")
    return a.unionByName(b)


def write_report(report: DataFrame, path: str, fmt: str = "json") -> str:
    w = report.write.mode("overwrite")
    (w.json(path) if fmt == "json" else w.option("header", True).csv(path))
    return path
