"""Inputs that the tables do not hold: chains, unseen classes, holes, wide
text, quoted CSV, clusters without a shared folder."""
import random

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.functions import text as TX
from tessera.functions.components import connected_components
from tessera.operators import anomaly as AN
from tessera.operators import charts as H
from tessera.operators import metrics as MET
from tessera.operators import models as ML
from tessera.operators import score as SC
from tessera.operators import select as P
from tessera.sources import csv_io as IO


def test_long_chain_is_one_cluster(spark):
    chain = spark.range(300).select("id", (F.col("id") * 0.45).alias("x"))
    labels = {r["cluster"] for r in AN.dbscan_labels(chain, "id", ["x"], 0.5, 2).collect()}
    assert labels == {0}


@pytest.mark.parametrize("d", [2, 4])
def test_dbscan_dense_cells_against_brute_force(spark, d):
    rng = random.Random(d)
    centres = [[rng.uniform(0, 2) for _ in range(d)] for _ in range(6)]
    pts = [(i, *[c + rng.gauss(0, 0.06) for c in rng.choice(centres)]) for i in range(220)]
    cols = [f"x{k}" for k in range(d)]
    df = spark.createDataFrame(pts, "id long, " + ", ".join(f"{c} double" for c in cols))
    near = {p[0]: [q[0] for q in pts if sum((a - b) ** 2 for a, b in zip(p[1:], q[1:])) <= 0.09] for p in pts}
    core = {i for i, n in near.items() if len(n) >= 5}
    root = {i: i for i in core}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in core:
        for j in near[i]:
            if j in core:
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    want = {i: find(i) if i in core else min((find(j) for j in near[i] if j in core), default=-1) for i in near}
    assert {r["id"]: r["cluster"] for r in AN.dbscan_labels(df, "id", cols, 0.3, 5).collect()} == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100)] + [(200, j) for j in range(201, 400)] + [(500, 500), (None, 3)]
    edges += [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(50)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 101)) and all(got[i] == 200 for i in range(201, 400))
    assert not {0, 200, 500} & set(got)


def test_unseen_class_and_missing_targets_are_counted(spark):
    rows = [(i, float(i % 7), "ab"[i % 2]) for i in range(200)] + [(1000 + i, 1.0, None) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, x double, y string")
    split = ML.train_test_split(df, "id").where("split = 'test' and y is not null")
    rare = [r["id"] for r in split.limit(3).collect()]
    df = df.withColumn("y", F.when(F.col("id").isin(rare), "zz").otherwise(F.col("y")))
    task, fm, train, test, k = ML.prepare(df, ["x"], "y", "id", task="classification")
    assert k == 3 and train.count() + test.count() == 200
    assert test.where(f"{ML.LABEL} = 2").count() == 3


def test_trees_take_any_text_and_holes(spark):
    rows = [(i, f"v{i % 77}", None if i % 5 == 0 else float(i % 77), i % 77 > 30) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, t string, x double, b boolean").withColumn("y", (F.col("id") % 77 > 40).cast("string"))
    board = ML.automl(df, ["t", "x", "b"], "y", "id", families=["decision_tree"], grid="small", encoder="index").leaderboard.collect()
    assert board[0]["error"] is None and board[0]["accuracy"] > 0.9
    m = SC.fit_scoring_model(df, ["t", "x", "b"], "y", "random_forest", trees=5, scaler="standard")
    out = SC.score_batch(m, df.withColumn("t", F.lit("never seen")), keep=["id"])
    assert out.count() == 600 and out.where("prediction is null").count() == 0
    rows_out, _ = ML.pca(df, ["x", "id"], 2, id_col="id")
    assert rows_out.count() == 600 and rows_out.where("pc_1 is null or isnan(pc_1)").count() == 0


def test_csv_round_trip(spark, tmp_path):
    texts = ['say "hi", ok', "two\nlines", '""', " padded ", "back\\slash", 'end"', "a,b", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i long, t string, u string")
    back = IO.read_table(spark, IO.write_csv(df, str(tmp_path / "c")), multi_line=True)
    assert sorted((r["i"], r["t"]) for r in back.collect()) == list(enumerate(texts))


def test_filter_exact_and_numbers(spark):
    big = 2 ** 53 + 1
    df = spark.createDataFrame([(7, big, 7.0, "7"), (8, big - 1, float("nan"), "nan")], "i int, l long, d double, s string")
    count = lambda c, t: P.filter_exact(df, c, t).count()
    assert [count("i", t) for t in ("7", "7.0", "7e0", "7.5", "nan", "x", "1e30", "-7")] == [1, 1, 1, 0, 0, 0, 0, 0]
    assert [count("l", str(big)), count("l", str(big - 1)), count("d", "7"), count("d", "nan"), count("s", "nan")] == [1, 1, 1, 0, 1]
    assert [r["s"] for r in P.to_numeric(df, "s").collect()] == [7.0, None]


def test_no_column_or_class_limit(spark):
    wide = spark.range(20).select(*[(F.col("id") * (k + 1)).cast("double").alias(f"c{k}") for k in range(14)])
    assert H.pair_grid(wide, wide.columns, 4).select("col_a", "col_b").distinct().count() == 196
    many = spark.range(1100).select((F.col("id") % 40).alias("y"), (F.col("id") % 39).alias("p"))
    cells = MET.confusion_matrix(many, "y", "p")
    assert cells.count() == 1600 and cells.agg(F.sum("count")).first()[0] == 1100


def test_chat_context_with_skipped_turns(spark):
    c = spark.createDataFrame([(1, 4, "user", "a"), (1, 9, "assistant", "b"), (2, 7, "user", "c")], "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in TX.chat_context(c, "sys", "q").collect())
    assert got == [(1, 0, "system", "sys"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "q"),
                   (2, 0, "system", "sys"), (2, 1, "user", "c"), (2, 2, "user", "q")]
    assert sorted(r["position"] for r in TX.chat_context(c).collect()) == [0, 0, 1]


def test_cluster_without_shared_folder_raises():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    fake = type("Session", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
