"""Batch scoring, defaults and model persistence.

The original predicted one hand-filled row with a forest refitted on every
click; here a fitted ``PipelineModel`` (encoders + assembler + model) is
saved once and applied to whole DataFrames — batch or stream — with the
class decoded and its probability attached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import is_numeric
from tessera.operators import cells
from tessera.operators.models import FEATURES, LABEL, feature_stages, fit_partitions, make_estimator
from tessera.operators.profile import detect_task, modes

#: Rows above which forests of classes are grown on counted cells; up to it
#: Spark's own trees take seconds.
LARGE_FIT = 250_000


def default_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """X6 form defaults: ``(position, column, mean, mode)`` — the mean of a
    numeric column, the most frequent value (smallest on ties) of any other.
    One aggregate for the means, one stacked job for the modes."""
    num = [c for c in cols if is_numeric(df.schema[c].dataType)]
    other = [c for c in cols if c not in num]
    spark = df.sparkSession
    pos = {c: i for i, c in enumerate(cols)}
    parts = []
    if num:
        agg = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(num)])
        parts.append(agg.select(F.explode(F.array(*[
            F.struct(F.lit(pos[c]).alias("position"), F.lit(c).alias("column"),
                     F.col(f"a{i}").alias("mean"), F.lit(None).cast("string").alias("mode"))
            for i, c in enumerate(num)])).alias("r")).select("r.*"))
    if other:
        m = modes(df, other)
        pm = F.create_map(*[x for c in other for x in (F.lit(c), F.lit(pos[c]))])
        parts.append(m.select(pm[F.col("column")].alias("position"), "column",
                              F.lit(None).cast("double").alias("mean"), "mode"))
    if not parts:
        return spark.createDataFrame([], "position int, column string, mean double, mode string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_defaults(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """Fill NULL inputs of rows to score from a ``default_values`` table
    (one row per column, broadcast as one wide row)."""
    cols = [r["column"] for r in defaults.select("column").collect()]
    wide = defaults.agg(*[F.max(F.when(F.col("column") == c, F.coalesce(F.col("mean").cast("string"),
                                                                        F.col("mode")))).alias(f"__d{i}")
                          for i, c in enumerate(cols)])
    out = df.crossJoin(F.broadcast(wide))
    for i, c in enumerate(cols):
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__d{i}").cast(df.schema[c].dataType)))
    return out.drop(*[f"__d{i}" for i in range(len(cols))])


def fit_scoring_model(df: DataFrame, features: Sequence[str], target: str, family: str = "random_forest",
                      task: str | None = None, encoder: str = "index", scaler: str | None = None,
                      **params) -> PipelineModel:
    """One PipelineModel = feature encoders + model (+ label decoder
    for classification), fitted on all given rows.  Forests of classes over more
    than ``LARGE_FIT`` rows are grown on counted cells (``cells``)."""
    df = df.where(F.col(target).isNotNull())
    task = task or detect_task(df, target).first()["task"]
    stages = feature_stages(df, features, target, task, encoder, scaler)
    if task == "classification":  # rows and classes of one pass
        classes = df.groupBy(target).agg(F.count(F.lit(1)).alias("__n"))
        n, k = classes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.lit(1))).first()
    else:
        n, k = df.count(), 2
    est = make_estimator(family, task, n, k, **params)
    spread_df = fit_partitions(df, n)
    if spread_df is not df:
        spread_df = spread_df.persist()
    if n > LARGE_FIT and encoder == "index" and scaler is None and cells.suits(est, len(features), k):
        encoders = Pipeline(stages=stages).fit(spread_df)
        inputs = next(s for s in stages if isinstance(s, VectorAssembler)).getInputCols()
        pm = PipelineModel([*encoders.stages, cells.fit_forest(est, encoders.transform(spread_df), inputs, len(encoders.stages[-1].labels))])
    else:
        pm = Pipeline(stages=[*stages, est]).fit(spread_df)
    if spread_df is not df:
        spread_df.unpersist()
    # the target encoder is only needed for training; rows to score have no target
    label_stage = pm.stages[-2]
    keep = [s for s in pm.stages if s is not label_stage]
    if task == "classification":
        keep.append(IndexToString(inputCol="prediction", outputCol="predicted_label",
                                  labels=label_stage.labels))
    return PipelineModel(keep)


def score_batch(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Apply a scoring model to every row: ``prediction`` (and
    ``predicted_label``, ``confidence`` = top class probability,
    ``probabilities`` array for classifiers)."""
    out = model.transform(df)
    cols = list(keep) + ["prediction"]
    if "predicted_label" in out.columns:
        cols.append("predicted_label")
    if "probability" in out.columns:
        arr = vector_to_array("probability")
        out = out.withColumn("probabilities", arr).withColumn("confidence", F.array_max(arr))
        cols += ["confidence", "probabilities"]
    return out.select(*cols)


def save_model(model: PipelineModel, path: str) -> str:
    """Persist encoders, assembler and model together."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


__all__ = ["default_values", "fill_defaults", "fit_scoring_model", "score_batch", "save_model",
           "load_model", "FEATURES", "LABEL"]
