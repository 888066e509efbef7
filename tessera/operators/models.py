"""Training, tuning and comparison.

Single models are Spark ML stages.  AutoML and comparison fit all their
candidates in shared passes over packed rows (``shared``, ``forest``, ``grid``).
Row assignment to train/test and to folds comes from
the id hash (``features.train_test_split`` / ``add_folds``) so it does not
depend on partitioning and survives recomputation after executor loss.
Only leaderboard rows (one per model family) are assembled on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import (Imputer, MinMaxScaler, OneHotEncoder, PCA, SQLTransformer, StandardScaler,
                                StringIndexer, StringIndexerModel, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import grid as GR
from tessera.operators import metrics as MET
from tessera.operators import shared as SH
from tessera.operators.features import add_folds, train_test_split
from tessera.operators.profile import detect_task, max_folds
from tessera.operators.rff import RandomFourierFeatures

# "No depth limit" in the original grids: Spark trees stop at depth 30.
UNLIMITED_DEPTH = 30
LABEL, FEATURES = "target_index", "features"


# --------------------------------------------------------------------------
# Feature pipeline
# --------------------------------------------------------------------------

def feature_stages(df: DataFrame, features: Sequence[str], target: str | None = None,
                   task: str = "classification", encoder: str = "index",
                   scaler: str | None = None, labels: Sequence[str] | None = None) -> list:
    """Stages turning raw columns into ``features`` (vector) and ``label``.

    Text features are dictionary-encoded (``StringIndexer``, alphabetical,
    unseen/NULL values get their own code) and optionally one-hot encoded.
    Codes are numbers to every model, trees included, so a column may hold
    any number of values.  Missing numbers take the mean of the rows fitted
    on; an optional ``standard``/``minmax`` scaler follows.  A classification
    target is indexed alphabetically (decode with the fitted indexer's
    labels), over ``labels`` if given, else over the rows fitted on; a class
    outside them is an error, never dropped.  A regression target is cast to
    double.
    """
    stages = []
    inputs = []
    numbers = [f for f in features if not isinstance(df.schema[f].dataType, T.StringType)]
    if numbers:
        casts = ", ".join(f"CAST(`{f}` AS DOUBLE) AS `{f}__num`" for f in numbers)
        stages += [SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"),
                   Imputer(strategy="mean", inputCols=[f"{f}__num" for f in numbers],
                           outputCols=[f"{f}__full" for f in numbers])]
    for f in features:
        dt = df.schema[f].dataType
        if isinstance(dt, T.StringType):
            stages.append(StringIndexer(inputCol=f, outputCol=f"{f}__idx", handleInvalid="keep",
                                        stringOrderType="alphabetAsc"))
            if encoder == "one_hot":
                # unseen/NULL already have their own index (the indexer's extra
                # slot), so the encoder needs no further "invalid" slot
                stages.append(OneHotEncoder(inputCol=f"{f}__idx", outputCol=f"{f}__ohe", dropLast=False))
                inputs.append(f"{f}__ohe")
            else:  # a plain number: no list of categories for trees to keep
                stages.append(SQLTransformer(statement=f"SELECT *, `{f}__idx` + 0.0D AS `{f}__code` FROM __THIS__"))
                inputs.append(f"{f}__code")
        else:
            inputs.append(f"{f}__full")
    out = FEATURES if scaler is None else "features_raw"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep"))
    if scaler == "standard":
        stages.append(StandardScaler(inputCol=out, outputCol=FEATURES, withMean=True, withStd=True))
    elif scaler == "minmax":
        stages.append(MinMaxScaler(inputCol=out, outputCol=FEATURES))
    if target is not None:
        if task == "classification":
            if labels is not None:
                stages.append(StringIndexerModel.from_labels(list(labels), target, LABEL, handleInvalid="error"))
            else:
                stages.append(StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc",
                                            handleInvalid="error"))
        else:
            stages.append(_CastStage(target, LABEL))
    return stages


def class_labels(df: DataFrame, target: str) -> list[str]:
    """The distinct classes of the whole table in order (they become the
    model's label list, so the driver holds them)."""
    rows = df.select(F.col(target).cast("string").alias("c")).where("c is not null").distinct().orderBy("c").collect()
    return [r["c"] for r in rows]


def _CastStage(inp: str, out: str):
    return SQLTransformer(statement=f"SELECT *, CAST(`{inp}` AS DOUBLE) AS `{out}` FROM __THIS__")


# --------------------------------------------------------------------------
# estimators
# --------------------------------------------------------------------------

def _io() -> dict:
    return {"labelCol": LABEL, "featuresCol": FEATURES}


def _depth(d):
    return UNLIMITED_DEPTH if d is None else int(d)


def make_estimator(family: str, task: str, n_rows: int, num_classes: int = 2, **p):
    """One estimator (or a Pipeline of stages) for a model family.

    C → ``regParam = 1/(C·n)`` with ``standardization=False`` (same objective
    scale as a per-sample-summed loss with an L2 penalty of ½‖w‖²).
    """
    n = max(n_rows, 1)
    seed = p.get("seed", 42)
    cls = task == "classification"
    if family == "logistic_regression":
        if not cls:
            raise ValueError("logistic regression needs a classification target")
        return LogisticRegression(maxIter=p.get("max_iter", 1000), regParam=1.0 / (p.get("C", 1.0) * n),
                                  standardization=False, **_io())
    if family == "linear_regression":
        if cls:
            raise ValueError("linear regression needs a numeric target")
        return LinearRegression(regParam=0.0, solver="normal", **_io())
    if family == "random_forest":
        k = RandomForestClassifier if cls else RandomForestRegressor
        return k(numTrees=p.get("trees", 100), maxDepth=_depth(p.get("depth", 5)), seed=seed,
                 featureSubsetStrategy="sqrt" if cls else "all", **_io())
    if family == "decision_tree":
        k = DecisionTreeClassifier if cls else DecisionTreeRegressor
        return k(maxDepth=_depth(p.get("depth", 5)), seed=seed, **_io())
    if family in ("gradient_boosting", "boosted_trees"):
        if cls:
            g = GBTClassifier(maxIter=p.get("trees", 100), maxDepth=_depth(p.get("depth", 3)), seed=seed, **_io())
            return g if num_classes <= 2 else OneVsRest(classifier=g, **_io())
        return GBTRegressor(maxIter=p.get("trees", 100), maxDepth=_depth(p.get("depth", 3)), seed=seed, **_io())
    if family == "svm":
        if not cls:
            raise ValueError("svm needs a classification target; use robust_regression")
        svc = LinearSVC(regParam=1.0 / (p.get("C", 1.0) * n), maxIter=p.get("max_iter", 100), labelCol=LABEL,
                        tol=p.get("tol", 1e-4),
                        featuresCol="rff" if p.get("kernel", "linear") == "rbf" else FEATURES)
        head = svc if num_classes <= 2 else OneVsRest(classifier=svc, featuresCol=svc.getFeaturesCol(),
                                                      labelCol=LABEL)
        if p.get("kernel", "linear") == "rbf":
            return Pipeline(stages=[RandomFourierFeatures(inputCol=FEATURES, outputCol="rff",
                                                          dim=p.get("dim", 256), seed=seed), head])
        return head
    if family == "robust_regression":
        # Stand-in for support-vector regression (not in MLlib): Huber loss.
        if cls:
            raise ValueError("robust_regression needs a numeric target")
        return LinearRegression(loss="huber", regParam=1.0 / (p.get("C", 1.0) * n), **_io())
    raise ValueError(f"unknown model family {family!r}")


CLASSIFICATION_FAMILIES = ["logistic_regression", "random_forest", "decision_tree", "svm", "gradient_boosting"]
REGRESSION_FAMILIES = ["random_forest", "decision_tree", "support_vector_regression", "gradient_boosting",
                       "linear_regression"]


# --------------------------------------------------------------------------
# Evaluation of a predictions table
# --------------------------------------------------------------------------

def evaluate(preds: DataFrame, task: str, num_classes: int = 2) -> dict:
    """Test metrics of one model in one or two small jobs."""
    if task == "classification":
        row = preds.agg(F.avg((F.col(LABEL) == F.col("prediction")).cast("double")).alias("a")).first()
        weighted = [F.try_divide(F.sum(F.col("support") * F.col(c)), F.sum("support")).alias(c)
                    for c in ("precision", "recall", "f1")]
        by_class = MET.per_class(preds, LABEL, "prediction").agg(*weighted).first()
        auc = reason = None
        try:
            if num_classes == 2:
                col = "probability" if "probability" in preds.columns else "rawPrediction"
                s = preds.withColumn("__score", vector_to_array(F.col(col))[1])
                auc = MET.roc_auc(s, LABEL, "__score", positive=1.0).first()[0]
            elif "probability" in preds.columns:
                arr = preds.withColumn("__p", vector_to_array("probability"))
                cols = {float(k): f"__p{k}" for k in range(num_classes)}
                for k in range(num_classes):
                    arr = arr.withColumn(f"__p{k}", F.col("__p")[k])
                auc = MET.roc_auc_ovo(arr, LABEL, cols).first()[0]
        except Exception as e:  # AUC is optional, as in the original ("N/A"); the row says why
            reason = f"roc_auc: {type(e).__name__}: {str(e)[:200]}"
        return {"accuracy": row["a"], "weighted_f1": by_class["f1"], "precision": by_class["precision"],
                "recall": by_class["recall"], "roc_auc": auc, "error": reason}
    r = preds.agg(F.avg(F.pow(F.col(LABEL) - F.col("prediction"), 2)).alias("mse"),
                  F.count(F.lit(1)).alias("n"), F.var_pop(LABEL).alias("v")).first()
    r2 = None if not r["v"] else 1.0 - r["mse"] / r["v"]
    return {"mse": r["mse"], "r2": r2}


LEADERBOARD_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("params", T.StringType()),
    T.StructField("cv_score", T.DoubleType()), T.StructField("accuracy", T.DoubleType()),
    T.StructField("weighted_f1", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("roc_auc", T.DoubleType()),
    T.StructField("mse", T.DoubleType()), T.StructField("r2", T.DoubleType()),
    T.StructField("error", T.StringType())])


def _f(v):
    return None if v is None else float(v)


def _lb_row(model, params=None, cv=None, metrics=None, error=None) -> tuple:
    m = metrics or {}
    return (model, params, _f(cv), _f(m.get("accuracy")), _f(m.get("weighted_f1")), _f(m.get("precision")),
            _f(m.get("recall")), _f(m.get("roc_auc")),
            _f(m.get("mse")), _f(m.get("r2")), error or m.get("error"))


def _params_text(params: dict) -> str:
    return ", ".join(f"{k}={v}" for k, v in params.items())


# --------------------------------------------------------------------------
# AutoML and comparison
# --------------------------------------------------------------------------

@dataclass
class TrainResult:
    task: str
    leaderboard: DataFrame
    models: dict = field(default_factory=dict)
    feature_model: PipelineModel | None = None
    num_classes: int = 2
    predictions: dict = field(default_factory=dict)


ROWS_PER_FIT_PARTITION = 50_000


def fit_partitions(df: DataFrame, n_rows: int) -> DataFrame:
    """Right-size the partitions of a fit input.

    Iterative MLlib fits run one task per partition per pass (L-BFGS step,
    tree level).  Aim at about one partition per ``ROWS_PER_FIT_PARTITION``
    rows, at most one per task slot: a single-row-group file is spread
    (one shuffle) and many tiny partitions are coalesced (narrow, no
    shuffle) — below that size per-task overhead dominates.  A large input
    (more rows per partition than the target) is never moved.
    """
    from tessera.functions.columns import _has_shuffle
    if _has_shuffle(df):
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    want = max(1, min(slots, n_rows // ROWS_PER_FIT_PARTITION))
    cur = df.rdd.getNumPartitions()
    if cur < want:
        return df.repartition(want)
    if cur > want and n_rows < cur * ROWS_PER_FIT_PARTITION:
        return df.coalesce(want)
    return df


def prepare(df: DataFrame, features: Sequence[str], target: str, id_col: str,
            test_pct: int = 20, folds: int = 3, seed: int = 42, task: str | None = None,
            encoder: str = "index", scaler: str | None = None):
    """Split by id hash, fit the feature pipeline on the train rows only,
    encode both parts and add fold numbers; both parts are cached.  Rows
    without a target can neither train nor test a model and are left out;
    classes are those of all other rows, so a class that only test rows have
    counts as missed."""
    df = df.where(F.col(target).isNotNull())
    task = task or detect_task(df, target).first()["task"]
    labels = class_labels(df, target) if task == "classification" else None
    data = train_test_split(df.select(id_col, *features, target), id_col, test_pct, seed)
    train_raw = data.where(F.col("split") == "train")
    train_raw = fit_partitions(train_raw, train_raw.count())
    fm = Pipeline(stages=feature_stages(df, features, target, task, encoder, scaler, labels)).fit(train_raw)
    train = add_folds(fm.transform(train_raw), id_col, folds, seed).select(id_col, FEATURES, LABEL, "fold").cache()
    test = fm.transform(data.where(F.col("split") == "test")).select(id_col, FEATURES, LABEL).cache()
    num_classes = 0
    if task == "classification":
        num_classes = len(fm.stages[-1].labels)
    return task, fm, train, test, num_classes


def packed_task(df: DataFrame, features: Sequence[str], target: str, id_col: str, test_pct: int, folds: int, seed: int,
                encoder: str, scaler: str | None, everything: bool) -> tuple[str, PipelineModel, GR.Task]:
    """Split, encoded and packed rows for the shared passes; folds are those of
    the id hash, over the train rows or ``everything``.  The number of folds of
    train rows is at most that of the smallest class."""
    task, fm, train, test, k = prepare(df, features, target, id_col, test_pct, folds, seed, encoder=encoder, scaler=scaler)
    if task == "classification" and not everything:
        folds = max_folds(train, LABEL, folds)
    rows = train.drop("fold").withColumn("split", F.lit(0)).unionByName(test.withColumn("split", F.lit(1)))
    rows = add_folds(rows, id_col, folds, seed).withColumn("key", F.xxhash64(id_col, vector_to_array(FEATURES)))
    slots = df.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < slots:  # few splits: every pass would leave slots idle
        rows = rows.repartition(slots)
    blocks, cuts = SH.pack(rows, FEATURES, LABEL)
    for part in (train, test):
        part.unpersist()
    return task, fm, GR.Task(blocks, cuts, k, SH.fits(folds, everything), seed)


def _scored_row(task: GR.Task, name: str, scored: GR.Scored, mean_mse: bool) -> tuple[tuple, GR.GridModel, DataFrame]:
    """(leaderboard row, model, test predictions) of the candidate with the
    best mean score over the folds: accuracy, or R squared."""
    cv = GR.cv_scores(task, scored)
    mean = cv.mean(1) if task.classes else cv.mean(1)[:, 1]
    best = int(mean.argmax())
    shown = float(cv.mean(1)[best, 0]) if mean_mse and not task.classes else float(mean[best])
    fitted = GR.calibration(task, scored, best) if scored.family == "svm" else None
    preds = GR.predictions(task, scored, best, LABEL, fitted)
    kind = "classification" if task.classes else "regression"
    row = _lb_row(name, _params_text(scored.candidates[best]), shown, evaluate(preds, kind, task.classes))
    return row, GR.GridModel(scored.family, scored.candidates[best], scored.scorers[best], task.classes, fitted), preds


def _all_families(task: GR.Task, wanted: dict[str, tuple[str, list[dict]]], mean_mse: bool, threads: int):
    """Rows, models and predictions of ``name -> (family, candidates)``.  All
    linear families go through one sequence of passes; the others run beside
    it.  A family that fails becomes a row with its error text."""
    from concurrent.futures import ThreadPoolExecutor
    together = {n: f for n, (f, _) in wanted.items() if f in GR.LINEAR and (f == "support_vector_regression") != bool(task.classes)}

    def run(names):
        out = {}
        try:
            if len(names) > 1 or names[0] in together:
                got = dict(zip(names, GR.linear(task, {wanted[n][0]: wanted[n][1] for n in names})))
            else:
                got = {names[0]: GR.run_family(task, *wanted[names[0]])}
        except Exception as e:  # a failing family is reported, not fatal
            return {n: (_lb_row(n, error=f"{type(e).__name__}: {str(e)[:300]}"), None, None) for n in names}
        for n, scored in got.items():
            try:
                out[n] = _scored_row(task, n, scored, mean_mse)
            except Exception as e:
                out[n] = _lb_row(n, error=f"{type(e).__name__}: {str(e)[:300]}"), None, None
        return out

    groups = [[n] for n in wanted if n not in together] + ([list(together)] if together else [])
    found = {}
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(groups)))) as pool:
        for got in pool.map(run, groups):
            found.update(got)
    return {n: found[n] for n in wanted}


def automl(df: DataFrame, features: Sequence[str], target: str, id_col: str, test_pct: int = 20,
           folds: int = 3, families: Sequence[str] | None = None, grid: str = "full",
           seed: int = 42, family_parallelism: int = 5, encoder: str = "index", scaler: str | None = None,
           grids: dict[str, list[dict]] | None = None) -> TrainResult:
    """Per family, grid search with cross-validation on the train rows
    (refit on all train rows), test metrics, one leaderboard row; a family
    that fails becomes a row with its error text.  ``grids`` replaces the
    candidates of the families that it names."""
    kind, fm, task = packed_task(df, features, target, id_col, test_pct, folds, seed, encoder, scaler, False)
    candidates = {**GR.grids(task.classes, grid), **(grids or {})}
    default = CLASSIFICATION_FAMILIES if kind == "classification" else REGRESSION_FAMILIES
    wanted = {f: (f, candidates.get(f, [{}])) for f in families or default}
    found = _all_families(task, wanted, False, family_parallelism)
    board = df.sparkSession.createDataFrame([r for r, _, _ in found.values()], LEADERBOARD_SCHEMA)
    return TrainResult(kind, board, {n: m for n, (_, m, _) in found.items() if m is not None}, fm, task.classes,
                       {n: p for n, (_, _, p) in found.items() if p is not None})


def cross_val_predictions(est, data: DataFrame, folds: int) -> DataFrame:
    """Fit on folds ≠ f, predict fold f, for every f; one long table of
    out-of-fold predictions ``(fold, label, prediction)``."""
    parts = []
    for f in range(folds):
        m = est.fit(data.where(F.col("fold") != f))
        parts.append(m.transform(data.where(F.col("fold") == f)).select("fold", LABEL, "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The compared models as the original's libraries set them by default.
COMPARED = {"logistic_regression": {"C": 1.0}, "random_forest": {"trees": 100, "depth": None}, "decision_tree": {"depth": None},
            "svm": {"C": 1.0, "kernel": "rbf"}, "support_vector_regression": {"C": 1.0, "kernel": "rbf"},
            "gradient_boosting": {"trees": 100, "depth": 3}, "boosted_trees": {"trees": 100, "depth": 6}, "linear_regression": {}}


def compare_models(df: DataFrame, features: Sequence[str], target: str, id_col: str,
                   models: Sequence[str], folds: int = 5, params: dict | None = None,
                   seed: int = 42, encoder: str = "index", scaler: str | None = None, threads: int = 5) -> TrainResult:
    """Chosen families with fixed parameters: fit on the 80% train rows,
    test metrics, plus k-fold cross-validation over **all** rows (mean
    accuracy or mean MSE), as the original did.  ``svm`` means regression for a
    numeric target.  Failures become rows; ``predictions`` holds each model's
    test rows, for ``compared_curves``."""
    if not 2 <= folds <= 10:
        raise ValueError("folds must be between 2 and 10")
    kind, fm, task = packed_task(df, features, target, id_col, 20, folds, seed, encoder, scaler, True)
    wanted = {}
    for name in models:
        family = "support_vector_regression" if name == "svm" and not task.classes else name
        wanted[name] = family, [{**COMPARED.get(family, {}), **(params or {}).get(name, {})}]
    found = _all_families(task, wanted, True, threads)
    board = df.sparkSession.createDataFrame([r for r, _, _ in found.values()], LEADERBOARD_SCHEMA)
    return TrainResult(kind, board, {n: m for n, (_, m, _) in found.items() if m is not None}, fm, task.classes,
                       {n: p for n, (_, _, p) in found.items() if p is not None})


def stacked_predictions(result: TrainResult) -> DataFrame:
    """(model, label, prediction, score) of all models' test rows; score is the
    probability of the class of index 1, null for more or fewer than two."""
    out = None
    for name, p in result.predictions.items():
        score = vector_to_array("probability")[1] if "probability" in p.columns and result.num_classes == 2 else F.lit(None).cast("double")
        part = p.select(F.lit(name).alias("model"), F.col(LABEL).alias("label"), "prediction", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def compared_curves(stacked: DataFrame, buckets: int = 1000) -> DataFrame:
    """M20 charts of ``(model, label 0/1, prediction, score)`` in one table
    (model, chart, x, y, n): ``confusion`` cells (x label, y prediction, n
    rows), and the points of ``roc`` (x false, y true positive rate) and ``pr``
    (x recall, y precision) at the lower bound of each of ``buckets`` score
    buckets that holds rows (n: rows at or above it).  Two classes; one
    aggregate by model, bucket and label, then running sums over at most
    ``buckets`` rows a model.  Rows without a score have no curve; a model
    with one class only gets no ROC point, and no PR point without positives."""
    cells = stacked.groupBy("model", F.col("label").alias("x"), F.col("prediction").alias("y")).agg(F.count(F.lit(1)).alias("n")) \
        .select("model", F.lit("confusion").alias("chart"), F.col("x").cast("double"), F.col("y").cast("double"), "n")
    bucket = F.least(F.floor(F.col("score") * buckets), F.lit(buckets - 1))
    counts = stacked.where("score is not null").groupBy("model", bucket.alias("b")).agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.lit(1)).alias("c"))
    above = Window.partitionBy("model").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("model")
    sums = counts.select("model", F.sum("p").over(above).alias("tp"), F.sum("c").over(above).alias("n"),
                         F.sum("p").over(whole).alias("pos"), F.sum("c").over(whole).alias("total"))
    roc = sums.where("pos > 0 and total > pos").select(
        "model", F.lit("roc").alias("chart"), ((F.col("n") - F.col("tp")) / (F.col("total") - F.col("pos"))).alias("x"),
        (F.col("tp") / F.col("pos")).alias("y"), "n")
    pr = sums.where("pos > 0").select("model", F.lit("pr").alias("chart"), (F.col("tp") / F.col("pos")).alias("x"),
                                      (F.col("tp") / F.col("n")).alias("y"), "n")
    return cells.unionByName(roc).unionByName(pr)


def leaderboard_best(result: TrainResult) -> DataFrame:
    """M21 on a training leaderboard: highest accuracy, else lowest MSE."""
    if result.task == "classification":
        return MET.best_model(result.leaderboard, "accuracy", True)
    return MET.best_model(result.leaderboard, "mse", False)


# --------------------------------------------------------------------------
# M22, K2, Y4
# --------------------------------------------------------------------------

def feature_importances(model, names: Sequence[str]) -> DataFrame:
    """``(feature, importance)`` of a tree model (or |coef| of a linear
    one), highest first."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    elif hasattr(m, "coefficients"):
        vals = [abs(v) for v in m.coefficients.toArray().tolist()]
    else:
        raise TypeError("model has neither importances nor coefficients")
    rows = list(zip(list(names), [float(v) for v in vals]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def rfe(df: DataFrame, features: Sequence[str], target: str, k: int, task: str | None = None,
        standardize: bool = True) -> DataFrame:
    """K2: recursive feature elimination: fit a linear model (logistic for a
    class target, least squares for a numeric one) on the remaining
    features, drop the one with the smallest Σ coef², repeat until k remain.
    Each round is one distributed fit over a cached DataFrame.
    Output ``(feature, ranking, selected)`` (ranking 1 = kept)."""
    df = df.where(F.col(target).isNotNull())
    task = task or detect_task(df, target).first()["task"]
    fm = Pipeline(stages=feature_stages(df, features, target, task,
                                        scaler="standard" if standardize else None)).fit(df)
    arr = fm.transform(df).select(vector_to_array(FEATURES).alias("__v"), LABEL).cache()
    remaining = list(range(len(features)))
    ranking = {}
    rank = len(features)
    from pyspark.ml.functions import array_to_vector
    while len(remaining) > k:
        sub = arr.select(array_to_vector(F.array(*[F.col("__v")[i] for i in remaining])).alias(FEATURES), LABEL)
        if task == "classification":
            m = LogisticRegression(maxIter=100, regParam=0.0, standardization=False, **_io()).fit(sub)
            coef = m.coefficientMatrix.toArray() if m.numClasses > 2 else m.coefficients.toArray()[None, :]
            score = (coef ** 2).sum(axis=0)
        else:
            m = LinearRegression(regParam=0.0, solver="normal", **_io()).fit(sub)
            score = m.coefficients.toArray() ** 2
        worst = int(score.argmin())
        ranking[remaining[worst]] = rank - k + 1
        rank -= 1
        remaining.pop(worst)
    for i in remaining:
        ranking[i] = 1
    arr.unpersist()
    rows = [(features[i], int(ranking[i]), ranking[i] == 1) for i in range(len(features))]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int, selected boolean")


def pca(df: DataFrame, cols: Sequence[str] | str, k: int, id_col: str | None = None,
        scale: bool = True) -> tuple[DataFrame, list[float]]:
    """Project onto the first k principal components (after
    standardising).  ``cols`` is a list of numeric columns or the name of
    one array/vector column.  Returns (rows with pc_1..pc_k, explained
    variance ratios)."""
    from pyspark.ml.functions import array_to_vector
    if isinstance(cols, str):
        dt = df.schema[cols].dataType
        vec = array_to_vector(F.col(cols)) if isinstance(dt, T.ArrayType) else F.col(cols)
        base = df.select(*([id_col] if id_col else []), vec.alias("__raw"))
        stages = []
    else:
        # missing numbers take their column's mean, so every row is projected
        base = df.select(*([id_col] if id_col else []), *[F.col(c).cast("double").alias(f"__n{i}") for i, c in enumerate(cols)])
        full = [f"__f{i}" for i in range(len(cols))]
        stages = [Imputer(strategy="mean", inputCols=[f"__n{i}" for i in range(len(cols))], outputCols=full),
                  VectorAssembler(inputCols=full, outputCol="__raw")]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True))
    stages.append(PCA(k=k, inputCol="__x" if scale else "__raw", outputCol="__pc"))
    model = Pipeline(stages=stages).fit(base)
    out = model.transform(base).withColumn("__a", vector_to_array("__pc"))
    out = out.select(*([id_col] if id_col else []), *[F.col("__a")[i].alias(f"pc_{i + 1}") for i in range(k)])
    return out, model.stages[-1].explainedVariance.toArray().tolist()
