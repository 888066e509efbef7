"""Metrics against brute force; split and fold properties."""
import re

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.ordering import dense_index, running_sums
from tessera.operators import features as K
from tessera.operators import metrics as M


def _scores(spark, n=400, seed=3):
    rng = np.random.RandomState(seed)
    y = rng.randint(0, 2, n)
    s = np.round(rng.rand(n) + 0.3 * y, 1)  # ties on purpose
    pdf = pd.DataFrame({"id": np.arange(n), "y": y.astype(bool), "s": s})
    return spark.createDataFrame(pdf), pdf


def test_auc_equals_mann_whitney(spark):
    df, pdf = _scores(spark)
    auc = M.roc_auc(df, "y", "s").first()["auc"]
    pos, neg = pdf[pdf.y].s.to_numpy(), pdf[~pdf.y].s.to_numpy()
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert math.isclose(auc, brute, rel_tol=1e-12)


def test_roc_curve_monotone_ends_at_one(spark):
    df, _ = _scores(spark)
    pts = M.roc_curve(df, "y", "s").orderBy(F.desc("threshold")).toPandas()
    assert (np.diff(pts.fpr) >= 0).all() and (np.diff(pts.tpr) >= 0).all()
    assert pts.fpr.iloc[-1] == 1.0 and pts.tpr.iloc[-1] == 1.0
    pr = M.pr_curve(df, "y", "s").orderBy(F.desc("threshold")).toPandas()
    assert pr.recall.iloc[-1] == 1.0


def test_confusion_and_f1(spark):
    rows = [(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, "c", "b"), (5, "c", "c"), (6, "a", "a")]
    df = spark.createDataFrame(rows, "id long, y string, p string")
    cm = {(r["label"], r["prediction"]): r["count"] for r in M.confusion_matrix(df, "y", "p").collect()}
    assert len(cm) == 9 and cm[("a", "a")] == 2 and cm[("c", "a")] == 0
    f1 = M.weighted_f1(df, "y", "p").first()[0]
    # per class: a: tp2 fp0 fn1 -> .8; b: tp1 fp2 fn0 -> .5; c: tp1 fp0 fn1 -> 2/3
    assert math.isclose(f1, (3 * 0.8 + 1 * 0.5 + 2 * (2 / 3)) / 6)


def test_ovo_auc_multiclass(spark):
    rng = np.random.RandomState(0)
    n = 300
    y = rng.randint(0, 3, n)
    p = rng.dirichlet([1, 1, 1], n)
    p[np.arange(n), y] += 0.5
    p = p / p.sum(1, keepdims=True)
    pdf = pd.DataFrame({"y": y.astype(float), "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2]})
    df = spark.createDataFrame(pdf)
    auc = M.roc_auc_ovo(df, "y", {0.0: "p0", 1.0: "p1", 2.0: "p2"}).first()[0]

    def bin_auc(pos, neg):
        return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    vals = []
    for a in range(3):
        for b in range(a + 1, 3):
            sub = pdf[pdf.y.isin([a, b])]
            vals.append(bin_auc(sub[sub.y == a][f"p{a}"].to_numpy(), sub[sub.y == b][f"p{a}"].to_numpy()))
            vals.append(bin_auc(sub[sub.y == b][f"p{b}"].to_numpy(), sub[sub.y == a][f"p{b}"].to_numpy()))
    assert math.isclose(auc, np.mean(vals), rel_tol=1e-12)


def test_running_sums_and_dense_index(spark):
    pdf = pd.DataFrame({"k": np.random.RandomState(1).permutation(500), "v": np.arange(500) % 7})
    df = spark.createDataFrame(pdf)
    out = running_sums(df, ["k"], ["v"], num_partitions=5).toPandas().sort_values("k")
    ref = pdf.sort_values("k").v.cumsum().to_numpy()
    assert (out.cum_v.to_numpy() == ref).all()
    d = dense_index(spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "s string"), "s")
    assert {r["s"]: r["code"] for r in d.collect()} == {"a": 0, "b": 1, "c": 2}


def test_split_independent_of_partitioning(spark):
    base = spark.range(2000).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in K.train_test_split(base, "k", 20).collect()}
    b = {r["k"]: r["split"] for r in K.train_test_split(base.repartition(7), "k", 20).collect()}
    assert a == b
    share = sum(v == "test" for v in a.values()) / len(a)
    assert 0.15 < share < 0.25
    folds = {r["fold"] for r in K.add_folds(base, "k", 4).collect()}
    assert folds == {0, 1, 2, 3}


def test_anova_counts_text_before_it_meets_the_dictionary(spark):
    rows = [(i % 3, None if i % 11 == 0 else "abc"[(i * i) % 3], float(i % 7), i % 13 == 0) for i in range(300)]
    df = spark.createDataFrame([("g" + str(g) if not drop else None, t, x) for g, t, x, drop in rows], "g string, t string, x double")
    out = K.anova_f(df, "g")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter.*\n(?:[:+\- |]*Project.*\n)*[:+\- |]*Aggregate", plan)
    codes = {None: -1, "a": 0, "b": 1, "c": 2}
    for r, at in zip(out.orderBy("position").collect(), (1, 2)):
        groups = [np.array([float(codes[row[1]] if at == 1 else row[2]) for row in rows if row[0] == g and not row[3]]) for g in range(3)]
        whole = np.concatenate(groups)
        between = sum(len(v) * (v.mean() - whole.mean()) ** 2 for v in groups) / 2
        within = sum(((v - v.mean()) ** 2).sum() for v in groups) / (len(whole) - 3)
        assert abs(r["f_value"] - between / within) < 1e-9


def test_anova_matches_numpy(spark):
    rng = np.random.RandomState(2)
    g = rng.randint(0, 3, 300)
    x = rng.randn(300) + g * 0.5 + 1e6  # large offset: shifted sums keep precision
    pdf = pd.DataFrame({"g": g.astype(str), "x": x})
    f = K.anova_f(spark.createDataFrame(pdf), "g", ["x"]).first()["f_value"]
    groups = [x[g == k] for k in range(3)]
    grand = x.mean()
    ssb = sum(len(v) * (v.mean() - grand) ** 2 for v in groups)
    ssw = sum(((v - v.mean()) ** 2).sum() for v in groups)
    ref = (ssb / 2) / (ssw / (len(x) - 3))
    assert math.isclose(f, ref, rel_tol=1e-6)


def test_mutual_info_independent_is_small(spark):
    rng = np.random.RandomState(5)
    pdf = pd.DataFrame({"y": rng.randint(0, 2, 4000).astype(str), "x": rng.rand(4000)})
    pdf["x2"] = pdf.y.astype(int) + rng.rand(4000) * 0.1
    mi = {r["column"]: r["mi"] for r in K.mutual_info(spark.createDataFrame(pdf), "y", ["x", "x2"], 10).collect()}
    assert mi["x"] < 0.01 and mi["x2"] > 0.6


def test_kde_binned_close_to_exact(spark):
    from tessera.operators import charts as H
    rng = np.random.RandomState(9)
    df = spark.createDataFrame(pd.DataFrame({"v": rng.randn(5000)}))
    ex = H.kde(df, "v", grid=50).orderBy("point").toPandas()
    bn = H.kde(df, "v", grid=50, method="binned").orderBy("point").toPandas()
    assert np.allclose(ex.y, bn.y)
    assert np.max(np.abs(ex.density - bn.density)) < 2e-3
    step = ex.y.iloc[1] - ex.y.iloc[0]
    assert abs(ex.density.sum() * step - 1.0) < 0.02


def test_histogram_auto_bins(spark):
    from tessera.operators import charts as H
    rng = np.random.RandomState(2)
    v = rng.randn(2000)
    h = H.histogram(spark.createDataFrame(pd.DataFrame({"v": v})), "v", "auto").orderBy("bin").toPandas()
    ref_edges = np.histogram_bin_edges(v, bins="auto")
    assert len(h) == len(ref_edges) - 1
    assert h["count"].sum() == 2000
    assert np.isclose(h.lo.iloc[0], v.min()) and np.isclose(h.hi.iloc[-1], v.max())


def test_exact_quantiles_skewed_groups(spark):
    from tessera.functions.quantiles import exact_quantiles
    rng = np.random.RandomState(11)
    hot = pd.DataFrame({"g": "hot", "v": np.round(rng.randn(3000), 2)})       # a third of the rows, ties
    rest = pd.DataFrame({"g": rng.choice(list("abcdefgh"), 6000), "v": rng.exponential(2.0, 6000)})
    single = pd.DataFrame({"g": ["solo"], "v": [4.2]})
    pdf = pd.concat([hot, rest, single], ignore_index=True)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf).repartition(5), "v", probs, ["g"]).toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        ref = np.quantile(sub.v.to_numpy(), probs)  # linear interpolation
        assert np.allclose(got.loc[g, [f"q{i}" for i in range(len(probs))]].to_numpy(dtype=float), ref,
                           rtol=0, atol=1e-9), g


def test_spread_does_not_run_shuffles(spark):
    from tessera.functions.columns import spread
    sc = spark.sparkContext
    agg = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    sc.setJobGroup("spread-probe", "spread-probe")
    out = spread(agg)
    assert sc.statusTracker().getJobIdsForGroup("spread-probe") == []
    assert out is agg
    sc.setJobGroup("other", "other")
    one = spark.read.parquet("/root/testdata/sf0.001/region.parquet")
    assert spread(one).rdd.getNumPartitions() >= sc.defaultParallelism


def test_charts_degenerate_inputs(spark):
    from tessera.operators import charts as H
    const = spark.createDataFrame([(i % 2, 3.0) for i in range(20)], "g int, v double")
    d = H.kde(const, "v", grid=10).collect()
    assert len(d) == 10 and all(r["density"] is None for r in d)
    holes = spark.createDataFrame([(1, None), (1, None), (2, 1.0), (2, 3.0)], "x int, y double")
    ls = {r["x"]: r for r in H.line_series(holes, "x", "y").collect()}
    assert ls[1]["n"] == 0 and ls[1]["mean"] is None and ls[2]["mean"] == 2.0
