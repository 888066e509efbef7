"""Permuted copies dealt out as cells."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import dealt as DL
from tessera.operators import explain as EX
from tessera.operators import score as SC


@pytest.fixture(scope="module")
def rows(spark):
    """Holes in features, labels and ids, and ids that come twice."""
    rng = np.random.RandomState(5)
    n = 3000
    x, z = rng.randn(n), rng.randint(0, 5, n).astype(float)
    y = np.where(x + z / 4 > 0.5, "yes", "no")
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "z": z, "t": rng.choice(["p", "q"], n), "y": y})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("id") % 11 > 0, F.col("x"))).withColumn("t", F.when(F.col("id") % 7 > 0, F.col("t")))
    df = df.withColumn("y", F.when(F.col("id") % 13 > 0, F.col("y"))).withColumn("id", F.when(F.col("id") != 5, F.col("id")))
    return df.unionByName(df.where("id < 40"))


def _both(model, rows, feats, monkeypatch, **sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(DL, k, v)
    paired = []
    old = EX._paired
    monkeypatch.setattr(EX, "_paired", lambda *a: paired.append(a) or old(*a))
    new = EX.permutation_importance(model, rows, feats, "y", "id", repeats=2).collect()
    assert not paired  # no row met another as a row
    monkeypatch.setattr(EX, "_tree_cells", lambda *a: None)
    was = EX.permutation_importance(model, rows, feats, "y", "id", repeats=2).collect()
    return ({r["feature"]: (r["importance"], r["std"]) for r in got} for got in (new, was))


@pytest.mark.parametrize("sizes", [{}, {"ROWS": 100, "PART": 250, "DEALT": 7000}])
def test_cells_score_as_rows_do(spark, rows, monkeypatch, sizes):
    feats = ["x", "z", "t"]
    model = SC.fit_scoring_model(rows, feats, "y", "random_forest", task="classification", trees=12, depth=4)
    new, was = _both(model, rows, feats, monkeypatch, **sizes)
    assert set(new) == set(was) == set(feats) and was["x"][0] > 0.1
    for f in feats:
        assert new[f] == pytest.approx(was[f], abs=1e-12)


def test_one_tree_and_boosting(spark, rows, monkeypatch):
    model = SC.fit_scoring_model(rows, ["x", "z"], "y", "gradient_boosting", task="classification", trees=5, depth=2)
    new, was = _both(model, rows, ["z", "x"], monkeypatch)
    assert all(new[f] == pytest.approx(was[f], abs=1e-12) for f in was)


def test_hashes_are_sparks(spark):
    ids = spark.range(50).select("id", F.xxhash64("id").alias("k"), F.xxhash64("id", F.lit(-3), F.lit(7961)).alias("h")).toPandas()
    assert (DL.hashed(DL.hashed(ids["k"].to_numpy().view(np.uint64), -3).view(np.uint64), 7961) == ids["h"]).all()
