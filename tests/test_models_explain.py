"""Models, explanations, persistence, streaming."""
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import explain as EX
from tessera.operators import models as ML
from tessera.operators import score as SC
from tessera.session import scratch_dir


@pytest.fixture(scope="module")
def planted(spark):
    """y depends on x1 only (x1 > 0), x2 is noise, c is an unused text column."""
    rng = np.random.RandomState(7)
    n = 1500
    x1, x2 = rng.randn(n), rng.randn(n)
    c = rng.choice(["p", "q", "r"], n)
    y = np.where(x1 + 0.1 * rng.randn(n) > 0, "yes", "no")
    pdf = pd.DataFrame({"id": np.arange(n), "x1": x1, "x2": x2, "c": c, "y": y, "t": 2.0 * x1 + 0.5})
    return spark.createDataFrame(pdf)


def test_shap_additivity_classifier(spark, planted):
    model = SC.fit_scoring_model(planted, ["x1", "x2", "c"], "y", "random_forest", task="classification",
                                 trees=15, depth=4)
    rows = planted.where("id < 200")
    shap, base = EX.tree_shap(model, rows, "id", ["x1", "x2", "c"])
    s = shap.groupBy("id", "class").agg(F.sum("shap").alias("s")).toPandas()
    probs = SC.score_batch(model, rows, keep=["id"]).select("id", "probabilities").toPandas()
    p = {r.id: r.probabilities for r in probs.itertuples()}
    for r in s.itertuples():
        assert math.isclose(r.s + base[r._2], p[r.id][r._2], abs_tol=1e-9)
    imp = EX.shap_importance(shap).where("class = 1").toPandas().set_index("feature")
    assert imp.loc["x1", "mean_abs_shap"] > 5 * imp.loc["x2", "mean_abs_shap"]


def test_shap_additivity_regression_gbt(spark, planted):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    va = VectorAssembler(inputCols=["x1", "x2"], outputCol="features")
    d = va.transform(planted)
    m = GBTRegressor(labelCol="t", maxIter=5, maxDepth=3, seed=1).fit(d)
    shap, base = EX.tree_shap(m, d.where("id < 100"), "id", ["x1", "x2"])
    s = shap.groupBy("id").agg(F.sum("shap").alias("s"))
    pred = m.transform(d.where("id < 100")).select("id", "prediction")
    j = s.join(pred, "id").toPandas()
    assert np.allclose(j.s + base[0], j.prediction, atol=1e-9)


def test_permutation_importance_unused_column_zero(spark, planted):
    model = SC.fit_scoring_model(planted, ["x1", "x2", "c"], "y", "random_forest", task="classification",
                                 trees=10, depth=4)
    imp = EX.permutation_importance(model, planted, ["x1", "x2", "c"], "y", "id", repeats=3).toPandas()
    imp = imp.set_index("feature")
    assert imp.loc["x1", "importance"] > 0.2
    assert abs(imp.loc["x2", "importance"]) < 0.03


@pytest.mark.parametrize("at_once", [1, 45_000, 10**9])
def test_permutation_keeps_every_row_once(spark, monkeypatch, at_once):
    """Under a label that all rows share the score is the share of one value, which no dealing out changes."""
    class Model:
        def transform(self, df):
            return df.withColumn("prediction", F.col("x"))

    rows = spark.range(20_000, numPartitions=4).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), F.rand(1).alias("z"), F.lit("3.0").alias("y"))
    monkeypatch.setattr(EX, "PAIRED", at_once, raising=False)
    imp = EX.permutation_importance(Model(), rows, ["x", "z"], "y", "id", repeats=2).collect()
    assert sorted((r["feature"], r["importance"], r["std"]) for r in imp) == [("x", 0.0, 0.0), ("z", 0.0, 0.0)]


def test_permuted_pairs_are_those_of_the_hash_orders(spark):
    rows = spark.range(3_000).select("id", (F.col("id") * 3).alias("x"), F.col("id").alias("kept"))
    orders = rows.select("id", *[F.xxhash64("id", F.lit(4), F.lit(s)).alias(n) for n, s in (("k", 9), ("v", 9 + 7919))]).toPandas()
    by_k, by_v = (orders.sort_values([c, "id"])["id"].to_numpy() for c in "kv")
    got = EX._paired(rows, 250_000, {4: "x"}, "id", 9).toPandas()
    assert len(got) == 3_000 and (got["kept"] == got["id"]).all() and (got["__copy"] == 4).all()
    assert dict(zip(got["id"], got["x"])) == dict(zip(by_k.tolist(), (by_v * 3).tolist()))


def test_lime_bins_all_features_in_one_pass(spark, planted):
    rows = planted.select("id", "y", *[(F.col("x1") * (i + 1) + F.col("x2")).alias(f"f{i}") for i in range(6)])

    def jobs(feats):
        model = SC.fit_scoring_model(rows, feats, "y", "logistic_regression", task="classification", max_iter=5)
        group = f"lime-{len(feats)}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            EX.lime_rows(model, rows, rows.where("id = 3"), feats, "id", n=50)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert 0 < jobs([f"f{i}" for i in range(6)]) == jobs(["f0", "f1"])


def test_score_stream_takes_many_files_at_a_time(spark, planted):
    from tessera.streaming.score_stream import score_stream
    model = SC.fit_scoring_model(planted, ["x1", "x2"], "y", "random_forest", task="classification", trees=2, depth=2)
    land = scratch_dir(spark, "landing-many")
    src = planted.select("id", "x1", "x2")
    src.repartition(20).write.parquet(land)
    out = score_stream(spark, model, land, src.schema, keep=["id"])
    assert out.count() == planted.count()
    assert out.select("scored_at").distinct().count() <= 2


def test_lime_recovers_sign(spark, planted):
    model = SC.fit_scoring_model(planted, ["x1", "x2"], "y", "logistic_regression", task="classification")
    rows = planted.where("id < 3")
    out = EX.lime_rows(model, planted, rows, ["x1", "x2"], "id", n=800, top=2).toPandas()
    assert set(out.id) == {0, 1, 2}
    top = out[out["rank"] == 1]
    assert (top.feature == "x1").all()


def test_save_load_same_predictions(spark, planted):
    model = SC.fit_scoring_model(planted, ["x1", "x2", "c"], "y", "random_forest", task="classification",
                                 trees=5, depth=3)
    path = SC.save_model(model, scratch_dir(spark, "model"))
    again = SC.load_model(path)
    a = SC.score_batch(model, planted, keep=["id"]).orderBy("id").collect()
    b = SC.score_batch(again, planted, keep=["id"]).orderBy("id").collect()
    assert [r.prediction for r in a] == [r.prediction for r in b]
    assert {r.predicted_label for r in a} <= {"yes", "no"}


def test_linear_regression_closed_form(spark, planted):
    model = SC.fit_scoring_model(planted, ["x1", "x2"], "t", "linear_regression", task="regression")
    lr = model.stages[-1]
    assert np.allclose(lr.coefficients.toArray(), [2.0, 0.0], atol=1e-8)
    assert math.isclose(lr.intercept, 0.5, abs_tol=1e-8)


def test_automl_small_grid(spark, planted):
    res = ML.automl(planted, ["x1", "x2", "c"], "y", "id", grid="small",
                    families=["logistic_regression", "decision_tree", "svm"])
    lb = res.leaderboard.toPandas().set_index("model")
    assert res.task == "classification"
    assert lb.error.isna().all(), lb.error.tolist()
    assert (lb.accuracy > 0.85).all()
    best = ML.leaderboard_best(res).first()
    assert best["accuracy"] == lb.accuracy.max()


def test_compare_models_reports_bad_pairs(spark, planted):
    res = ML.compare_models(planted, ["x1", "x2"], "y", "id", ["decision_tree", "linear_regression"], folds=3)
    lb = res.leaderboard.toPandas().set_index("model")
    assert lb.loc["linear_regression", "error"] and lb.loc["decision_tree", "error"] is None
    assert lb.loc["decision_tree", "cv_score"] > 0.8


def test_rfe_keeps_signal(spark, planted):
    out = ML.rfe(planted, ["x1", "x2"], "y", 1, task="classification").toPandas().set_index("feature")
    assert out.loc["x1", "selected"] and not out.loc["x2", "selected"]


def test_rff_svm_nonlinear(spark):
    rng = np.random.RandomState(3)
    X = rng.randn(800, 2)
    y = np.where((X ** 2).sum(1) < 1.2, "in", "out")
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(800), "a": X[:, 0], "b": X[:, 1], "y": y}))
    lin = SC.fit_scoring_model(df, ["a", "b"], "y", "svm", task="classification", kernel="linear")
    rbf = SC.fit_scoring_model(df, ["a", "b"], "y", "svm", task="classification", kernel="rbf", C=10.0)

    def acc(m):
        return m.transform(df).agg(F.avg((F.col("predicted_label") == F.col("y")).cast("double"))).first()[0]
    assert acc(rbf) > acc(lin) + 0.15


def test_stream_equals_batch(spark, planted):
    from tessera.streaming.score_stream import score_stream
    model = SC.fit_scoring_model(planted, ["x1", "x2", "c"], "y", "decision_tree", task="classification", depth=3)
    land = scratch_dir(spark, "land")
    src = planted.select("id", "x1", "x2", "c")
    src.repartition(3).write.parquet(land)
    streamed = score_stream(spark, model, land, src.schema, keep=["id"]).select("id", "prediction")
    batch = SC.score_batch(model, src, keep=["id"]).select("id", "prediction")
    assert streamed.count() == batch.count() == 1500
    assert streamed.exceptAll(batch).count() == 0


def test_pca_explained_variance(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows, ev = ML.pca(emb, "embedding", 3, id_col="vec_id")
    assert rows.count() == emb.count() and len(ev) == 3
    assert ev[0] >= ev[1] >= ev[2] > 0


def test_feature_pipeline_scaler_and_one_hot(spark, planted):
    from pyspark.ml import Pipeline
    stages = ML.feature_stages(planted, ["x1", "x2", "c"], "y", "classification", encoder="one_hot",
                               scaler="standard")
    out = Pipeline(stages=stages).fit(planted).transform(planted)
    arr = out.select(vector_to_array("features").alias("v")).toPandas()
    m = np.vstack(arr.v.to_numpy())
    assert m.shape[1] == 2 + 4  # two numbers + three categories and the 'unseen' slot
    assert np.allclose(m[:, :2].mean(0), 0, atol=1e-9) and np.allclose(m[:, :2].std(0, ddof=1), 1, atol=1e-9)


def test_registered_queries_run_whole_jobs(spark, monkeypatch):
    import inspect
    from types import SimpleNamespace
    from conftest import SF_SMALL
    from tessera.plans import workloads as W
    ran = {}

    def held(name):
        spec = inspect.signature(getattr(ML, name))

        def run(*a, **b):
            given = spec.bind(*a, **b)
            given.apply_defaults()
            ran.setdefault(name, []).append(given.arguments)
            return SimpleNamespace(leaderboard=None)
        return run
    for name in ("automl", "compare_models", "rfe"):
        monkeypatch.setattr(W.ML, name, held(name))
    for query in ("automl", "automl_regression", "compare_models", "rfe"):
        W.QUERIES[query](spark, SF_SMALL)
    assert [g["grid"] for g in ran["automl"]] == ["full", "full"]
    assert ran["compare_models"][0]["folds"] == 5
    assert not ran["compare_models"][0]["params"]
    assert {"l_linenumber", "l_returnflag", "l_linestatus"} <= set(ran["rfe"][0]["features"])


def test_shap_kernel_follows_the_definition():
    """Steps, categories and missing values; a compiled tree holds no table of
    its groups by its leaves, whose product was most of the kernel's time."""
    rng, depth, p = np.random.RandomState(5), 8, 4
    inner = (1 << depth) - 1
    feat = np.concatenate([rng.randint(0, p, inner), np.full(inner + 1, -1)])
    thr = np.concatenate([rng.rand(inner), np.zeros(inner + 1)])
    cats = {3: np.array([0.0, 2.0])}
    feat[3] = 3
    leaves = []

    def walk(node, path):
        if node < inner:
            walk(2 * node + 1, [*path, (node, True)])
            walk(2 * node + 2, [*path, (node, False)])
            return
        feats = list(dict.fromkeys(int(feat[n]) for n, _ in path))
        leaves.append({"steps": [(n, w, feats.index(int(feat[n]))) for n, w in path], "feats": np.array(feats),
                       "table": EX._leaf_table(rng.rand(len(feats))), "v": rng.rand(2)})
    walk(0, [])
    tree = EX._compile_tree({"feat": feat, "thr": thr, "cats": cats, "leaves": leaves}, 2, p)
    x = rng.rand(60, p)
    x[:, 3] = rng.randint(0, 4, 60)
    x[7, 1] = np.nan
    expected = np.zeros((60, 2, p))
    for i, row in enumerate(x):
        for lf in leaves:
            pattern = (1 << len(lf["feats"])) - 1
            for n, went_left, j in lf["steps"]:
                left = row[feat[n]] in cats[n] if n in cats else row[feat[n]] <= thr[n]
                if left != went_left:
                    pattern &= ~(1 << j)
            for j, f in enumerate(lf["feats"]):
                expected[i, :, f] += lf["table"][pattern, j] * lf["v"]
    assert np.allclose(EX._shap_batch(x, [tree], 2, p), expected, rtol=0, atol=1e-12)
    groups = sum(len(lf["feats"]) for lf in leaves)
    assert max(a.size for a in tree.values() if isinstance(a, np.ndarray)) < groups * len(leaves) // 4


def test_fit_counts_rows_and_classes_in_one_pass(spark, planted, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def watched(it):
        for b in it:
            seen.add(len(b))
            yield b

    class Counted(Exception):
        pass

    def stop(family, task, n, k, **_):
        raise Counted(n, k)

    monkeypatch.setattr(SC, "make_estimator", stop)
    rows = planted.select("x1", F.when(F.col("id") >= 10, F.col("y")).alias("y")).mapInPandas(watched, "x1 double, y string")
    with pytest.raises(Counted) as got:
        SC.fit_scoring_model(rows, ["x1"], "y", task="classification")
    assert got.value.args == (1490, 2) and seen.value == 1500


def test_stream_rows_land_without_the_splits(spark, monkeypatch, tmp_path):
    from tessera.plans import workloads as W
    (spark.range(50).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 3).alias("l_linenumber"),
        F.when(F.col("id") != 4, F.col("id").cast("double")).alias("l_quantity"), F.lit(2.5).alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"), F.lit(0.2).alias("l_tax"), F.lit("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"))
     .withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).drop("n").write.parquet(f"{tmp_path}/lineitem.parquet"))
    rows = W._explain_rows(spark, str(tmp_path)).select("row_id", *W.EXPLAIN_FEATURES)
    monkeypatch.setattr(W, "_explain_setup", lambda *_: (None, None, None))
    monkeypatch.setattr(W.ST, "score_stream", lambda spark, model, path, schema, keep: spark.read.schema(schema).parquet(path))
    landed = W.QUERIES["score_stream"](spark, str(tmp_path))
    assert landed.count() == 100 and landed.exceptAll(rows).isEmpty() and rows.exceptAll(landed).isEmpty()
