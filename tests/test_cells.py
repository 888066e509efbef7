"""Forests on counted cells."""
import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import cells as CE
from tessera.operators import explain as EX
from tessera.operators import score as SC


def _rows(spark, n=4000, classes=2, wide=False):
    rng = np.random.RandomState(3)
    a, b = rng.randint(0, 30, n).astype(float), rng.randint(0, 9, n) / 4
    c = rng.randn(n) if wide else rng.randint(-5, 6, n) * 1.5
    y = (a + 3 * b * (c > 0) + 4 * rng.randn(n) > 15).astype(int) + (classes > 2) * (c > 3)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c, "target_index": y.astype(float)}))


def _nodes(model):
    pdf, _, _ = EX.tree_table(model)
    pdf["at"] = [tuple(x) for x in pdf["cats"]]
    pdf["stats"] = [tuple(x) for x in pdf["impurityStats"]]
    return pdf.sort_values("id")[["id", "prediction", "rawCount", "leftChild", "rightChild", "feature", "at", "stats"]].values.tolist()


def test_a_tree_on_cells_is_sparks_tree_on_rows(spark):
    for classes in (2, 3):
        rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(_rows(spark, classes=classes))
        ours = CE.fit_forest(RandomForestClassifier(labelCol="target_index", numTrees=1, maxDepth=5, bootstrap=False, featureSubsetStrategy="all", seed=-3),
                             rows, ["a", "b", "c"], classes)
        theirs = DecisionTreeClassifier(labelCol="target_index", maxDepth=5).fit(rows)
        assert _nodes(ours) == _nodes(theirs)
        assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray())


def test_the_forest_on_cells_predicts_as_sparks(spark):
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(_rows(spark, wide=True))
    est = RandomForestClassifier(labelCol="target_index", numTrees=60, maxDepth=4, featureSubsetStrategy="sqrt", seed=5)
    ours, theirs = CE.fit_forest(est, rows, ["a", "b", "c"], 2), est.fit(rows)
    p, q = (np.array([r[0] for r in m.transform(rows).orderBy("id").select(vector_to_array("probability")[1]).collect()]) for m in (ours, theirs))
    assert ours.getNumTrees == 60 and abs(p - q).mean() < 0.02 and abs(p - q).max() < 0.15
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.06)


def test_bags_do_not_depend_on_partitions(spark):
    rows, est = _rows(spark), RandomForestClassifier(labelCol="target_index", numTrees=5, maxDepth=3, featureSubsetStrategy="sqrt", seed=5)
    got = [[(t.toDebugString) for t in CE.fit_forest(est, r, ["a", "b", "c"], 2).trees] for r in (rows.coalesce(1), rows.repartition(7, "b"))]
    strip = [[x.split("\n", 1)[1] for x in g] for g in got]
    assert strip[0] == strip[1] and len(set(strip[0])) > 1


def test_a_bag_holds_the_rows_of_a_cell_in_its_draws(spark):
    """All rows are one cell: a tree's root holds Poisson(n) of them, not n times Poisson(1)."""
    rows = spark.range(10_000).select(F.lit(1.0).alias("a"), F.lit(0.0).alias("target_index"))
    est = RandomForestClassifier(labelCol="target_index", numTrees=40, maxDepth=2, featureSubsetStrategy="sqrt", seed=5)
    held = [r["n"] for r in EX.tree_table(CE.fit_forest(est, rows, ["a"], 2))[0].rename(columns={"rawCount": "n"}).to_dict("records")]
    assert len(held) == 40 and abs(np.mean(held) - 10_000) < 80 and 40 < np.std(held) < 200


def test_large_fits_go_by_cells(spark, monkeypatch):
    called = []
    fit = CE.fit_forest
    monkeypatch.setattr(CE, "fit_forest", lambda *a: called.append(a) or fit(*a))
    monkeypatch.setattr(SC, "LARGE_FIT", 1000)
    rows = _rows(spark).select("id", "a", F.when(F.col("id") % 9 > 0, F.col("b")).alias("b"), F.col("c").cast("string").alias("t"),
                               F.when(F.col("target_index") > 0, "yes").otherwise("no").alias("y"))
    model = SC.fit_scoring_model(rows, ["a", "b", "t"], "y", "random_forest", task="classification", trees=10, depth=4)
    assert len(called) == 1
    out = SC.score_batch(model, rows, keep=["id", "y"]).withColumn("hit", (F.col("y") == F.col("predicted_label")).cast("int")).agg(
        F.avg("hit"), F.count("*")).first()
    assert out[0] > 0.8 and out[1] == 4000
    shap, base = EX.tree_shap(model, rows.where("id < 50"), "id", ["a", "b", "t"])
    s = shap.groupBy("id", "class").agg(F.sum("shap").alias("s")).toPandas()
    p = {r["id"]: r["probabilities"] for r in SC.score_batch(model, rows.where("id < 50"), keep=["id"]).collect()}
    assert all(math.isclose(r.s + base[r._2], p[r.id][r._2], abs_tol=1e-9) for r in s.itertuples())


def test_cuts():
    assert CE.cuts_of([1.0, 1.0, 3.0, 5.0, float("nan")], 32).tolist() == [2.0, 4.0]
    assert CE.cuts_of([], 32).tolist() == [] and CE.cuts_of([7.0] * 5, 32).tolist() == []
    many = CE.cuts_of(np.arange(2001.0), 32)
    assert len(many) == 31 and abs(np.diff(np.concatenate([[0], many, [2000]])) - 62.5).max() < 2
