"""Model explanation (X1-X5): TreeSHAP, permutation importance, local surrogates.

**TreeSHAP (path-dependent, Lundberg et al. 2018).**  For a leaf with value
v and the m distinct features M on its path, let z_g be the product of
child/parent cover over the path's splits on g and o_g(x) = 1 when x
satisfies all of them.  The leaf adds to feature f

    φ_f = v · (o_f − z_f) · Σ_{S ⊆ M∖f} |S|!(m−|S|−1)!/m! · Π_{g∈S} o_g · Π_{g∉S∪f} z_g

As o is a bit pattern, every leaf gets a 2^m × m table (built once on the
driver from the model — its size is bounded by the model, not the data);
the executor kernel (``mapInPandas``) computes each row's pattern per leaf
with numpy and adds the looked-up values.  Σφ + base equals the model
output exactly (base = Σ v·Π z).

**Permutation importance** stacks (feature, repeat) copies, as many at a time
as hold a bounded number of rows: inside each copy the feature column is
re-paired by two independent hash orders (global ranks from parts of
the hash range, never one task), then one ``transform`` and one grouped metric.
For classes and tree models the copies are dealt out as cells (``dealt``).

**Local surrogate (LIME-style)**: perturbations of the chosen rows are a
cross join with a fixed-size ``range(n)``; one weighted ridge fit per row
runs in ``applyInPandas`` (n rows per group, bounded by the parameter).
"""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import spread
from tessera.operators import dealt as DL
from tessera.session import scratch_dir

# --------------------------------------------------------------------------
# Tree structure
# --------------------------------------------------------------------------


def _split_model(model):
    """(feature stages as PipelineModel or None, tree model, decoder stages)."""
    if isinstance(model, PipelineModel):
        stages = list(model.stages)
        idx = max(i for i, s in enumerate(stages) if hasattr(s, "featureImportances"))
        pre = PipelineModel(stages[:idx]) if idx else None
        return pre, stages[idx]
    return None, model


def tree_table(tree_model) -> tuple[pd.DataFrame, list[float], str]:
    """Node rows of a fitted tree model (saved to the shared scratch folder
    and read back as Parquet), tree weights and the kind
    ('forest' = average, 'boost' = weighted sum, 'tree')."""
    spark = _spark()
    path = scratch_dir(spark, "tree-model")
    tree_model.write().overwrite().save(path)
    data = spark.read.parquet(os.path.join(path, "data"))
    if "treeID" in data.columns:
        nodes = data.select("treeID", "nodeData.*")
    else:
        nodes = data.select(F.lit(0).alias("treeID"), "*")
    pdf = nodes.select("treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild",
                       F.col("split.featureIndex").alias("feature"),
                       F.col("split.leftCategoriesOrThreshold").alias("cats"),
                       F.col("split.numCategories").alias("ncat")).toPandas()
    name = type(tree_model).__name__
    if "GBT" in name:
        weights, kind = list(tree_model.treeWeights), "boost"
    elif "RandomForest" in name:
        weights, kind = [1.0] * tree_model.getNumTrees, "forest"
    else:
        weights, kind = [1.0], "tree"
    return pdf, weights, kind


def _spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def _leaf_table(z: np.ndarray) -> np.ndarray:
    """2^m × m table of φ/v for every satisfied-pattern (bit g = o_g)."""
    m = len(z)
    P = 1 << m
    pats = ((np.arange(P)[:, None] >> np.arange(m)) & 1).astype(np.float64)
    w = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
    out = np.zeros((P, m))
    for j in range(m):
        C = np.zeros((P, m))
        C[:, 0] = 1.0
        for g in range(m):
            if g == j:
                continue
            og = pats[:, g:g + 1] == 1
            shifted = np.concatenate([np.zeros((P, 1)), C[:, :-1]], axis=1)
            C = np.where(og, shifted + z[g] * C, z[g] * C)
        out[:, j] = (pats[:, j] - z[j]) * (C @ w)
    return out


def prepare_trees(pdf: pd.DataFrame, weights: list[float], kind: str, classification: bool) -> tuple[list, np.ndarray]:
    """Per tree: split arrays and leaf records (path, features, table,
    value vector); plus the base value vector."""
    trees = []
    base = None
    for t, g in pdf.groupby("treeID"):
        g = g.set_index("id")
        n = int(g.index.max()) + 1
        feat = np.full(n, -1, dtype=np.int64)
        thr = np.zeros(n)
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        cats = {}
        cover = np.zeros(n)
        vals = {}
        class_shares = classification and kind != "boost"
        for nid, r in g.iterrows():
            stats = np.asarray(r["impurityStats"], dtype=np.float64)
            if class_shares:
                cover[nid] = stats.sum()
                vals[nid] = stats / stats.sum() if stats.sum() > 0 else stats
            else:
                cover[nid] = stats[0] if len(stats) else float(r["rawCount"])
                vals[nid] = np.array([r["prediction"]])
            if r["leftChild"] >= 0:
                feat[nid], left[nid], right[nid] = r["feature"], r["leftChild"], r["rightChild"]
                if r["ncat"] is not None and r["ncat"] > 0:
                    cats[nid] = np.asarray(r["cats"], dtype=np.float64)
                else:
                    thr[nid] = float(r["cats"][0])
        wt = weights[int(t)] / (len(weights) if kind == "forest" else 1.0)
        leaves = []
        tree_base = 0.0

        def walk(nid, path):
            nonlocal tree_base
            if left[nid] < 0:
                feats = []
                for node, _ in path:
                    if feat[node] not in feats:
                        feats.append(int(feat[node]))
                z = np.ones(len(feats))
                steps = []
                for node, went_left in path:
                    j = feats.index(int(feat[node]))
                    child = left[node] if went_left else right[node]
                    z[j] *= cover[child] / cover[node] if cover[node] > 0 else 0.0
                    steps.append((int(node), bool(went_left), j))
                v = vals[nid] * wt
                leaves.append({"steps": steps, "feats": np.array(feats, dtype=np.int64),
                               "table": _leaf_table(z) if feats else np.zeros((1, 0)), "v": v})
                tree_base = tree_base + v * float(np.prod(z))
                return
            walk(left[nid], path + [(nid, True)])
            walk(right[nid], path + [(nid, False)])

        walk(0, [])
        base = tree_base if base is None else base + tree_base
        trees.append({"feat": feat, "thr": thr, "cats": cats, "leaves": leaves})
    return trees, np.atleast_1d(base)


def _compile_tree(tr: dict, n_out: int, p: int) -> dict | None:
    """Flatten one tree's leaf records for the vectorised kernel.

    Groups are (leaf, path feature) pairs.  ``steps`` has the groups' first
    steps, second steps and so on, ``bits`` the leaves' first features, second
    features and so on; the leaves' tables stand one below the other, as wide
    as the longest; ``used`` are the groups' places in the rows of all leaves,
    which ``vx`` spreads over outputs and features.
    """
    inner = np.flatnonzero(tr["feat"] >= 0)
    pos = {int(n): i for i, n in enumerate(inner)}
    leaves = [lf for lf in tr["leaves"] if len(lf["feats"])]
    if not leaves:
        return None
    groups = [(li, j) for li, lf in enumerate(leaves) for j in range(len(lf["feats"]))]
    of_group = [[(pos[node], went_left) for node, went_left, jj in leaves[li]["steps"] if jj == j] for li, j in groups]
    steps = []
    for r in range(max(map(len, of_group))):
        has = [g for g, s in enumerate(of_group) if len(s) > r]
        steps.append((np.array(has), np.array([of_group[g][r][0] for g in has]),
                      np.array([of_group[g][r][1] for g in has], dtype=bool)[:, None]))
    width = max(len(lf["feats"]) for lf in leaves)
    bits = []
    for j in range(width):
        has = [(li, g) for g, (li, jj) in enumerate(groups) if jj == j]
        bits.append(tuple(np.array(has).T))
    table = np.concatenate([np.pad(lf["table"], ((0, 0), (0, width - lf["table"].shape[1]))) for lf in leaves])
    vx = np.zeros((n_out, len(groups), p))
    for g, (li, j) in enumerate(groups):
        vx[:, g, leaves[li]["feats"][j]] = leaves[li]["v"]
    ends = np.cumsum([len(lf["table"]) for lf in leaves])
    return {"feat": tr["feat"][inner], "thr": tr["thr"][inner][:, None], "cats": {pos[n]: v for n, v in tr["cats"].items()},
            "steps": steps, "bits": bits, "table": table, "vx": vx, "used": np.array([li * width + j for li, j in groups]),
            "first": np.concatenate([[0], ends[:-1]])[:, None]}


def _shap_batch(x: np.ndarray, compiled: list, n_out: int, p: int) -> np.ndarray:
    """(rows, outputs, features) SHAP values.  Every split is evaluated once per
    row; a group holds if all its steps do, the groups of a leaf are its bit
    pattern, and that is a row of the leaf's table.  Nodes, groups and leaves
    are the first axis, so that each operation runs along adjoining rows."""
    N, columns = len(x), np.ascontiguousarray(x.T)
    phi = np.zeros((n_out, N, p))
    for t in compiled:
        dec = columns[t["feat"]] <= t["thr"]
        for node, cats in t["cats"].items():
            dec[node] = np.isin(columns[t["feat"][node]], cats)
        (_, nodes, left), *more = t["steps"]
        ok = dec[nodes] == left
        for has, nodes, left in more:
            ok[has] &= dec[nodes] == left
        row = np.repeat(t["first"], N, axis=1)  # leaves × N
        for j, (leaf, group) in enumerate(t["bits"]):
            row[leaf] += ok[group].astype(np.int64) << j
        vals = t["table"].take(row.T, axis=0).reshape(N, -1).take(t["used"], axis=1)  # N × groups
        for k in range(n_out):
            phi[k] += vals @ t["vx"][k]
    return phi.transpose(1, 0, 2)


def tree_shap(model, df: DataFrame, id_col: str, feature_names: Sequence[str] | None = None,
              features_col: str = "features") -> tuple[DataFrame, list[float]]:
    """SHAP values of a fitted tree model (decision tree, random forest,
    GBT) for every row of ``df``: long form ``(id, class, feature, shap)``
    (class = output index; regression and boosting have one output), plus
    the base value per output.

    ``model`` is a tree model or a PipelineModel whose feature stages
    produce ``features_col``; ``feature_names`` name the vector slots.
    """
    pre, tm = _split_model(model)
    classification = hasattr(tm, "numClasses")
    pdf, weights, kind = tree_table(tm)
    trees, base = prepare_trees(pdf, weights, kind, classification)
    rows = pre.transform(df) if pre is not None else df
    p = tm.numFeatures
    names = list(feature_names) if feature_names else [f"f{i}" for i in range(p)]
    n_out = len(base)
    compiled = [c for c in (_compile_tree(t, n_out, p) for t in trees) if c is not None]
    bc = rows.sparkSession.sparkContext.broadcast(compiled)
    id_type = rows.schema[id_col].dataType

    def kernel(it):
        trs = bc.value
        for b in it:
            if len(b) == 0:
                continue
            x = np.vstack(b["__v"].to_numpy()).astype(np.float64)
            phi = _shap_batch(x, trs, n_out, p)
            ids = np.repeat(b[id_col].to_numpy(), n_out * p)
            cls = np.tile(np.repeat(np.arange(n_out), p), len(b))
            feat = np.tile(np.array(names, dtype=object), len(b) * n_out)
            yield pd.DataFrame({id_col: ids, "class": cls.astype(np.int32), "feature": feat,
                                "shap": phi.reshape(-1)})

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("class", T.IntegerType()),
                           T.StructField("feature", T.StringType()), T.StructField("shap", T.DoubleType())])
    out = spread(rows.select(id_col, vector_to_array(features_col).alias("__v"))).mapInPandas(kernel, schema)
    return out, [float(b) for b in base]


def shap_importance(shap: DataFrame) -> DataFrame:
    """Mean |SHAP| per (class, feature)."""
    return shap.groupBy("class", "feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def shap_row(shap: DataFrame, base: Sequence[float], id_col: str, row_id) -> DataFrame:
    """One row's SHAP values with the base (expected) value per class."""
    spark = shap.sparkSession
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(base)], "class int, base double")
    return shap.where(F.col(id_col) == F.lit(row_id)).join(F.broadcast(b), "class")


# --------------------------------------------------------------------------
# X4 permutation importance
# --------------------------------------------------------------------------

def _score(pred: DataFrame, label: str, task: str, by: list[str]) -> DataFrame:
    if task == "classification":
        same = F.col(label).cast("string") == F.col("prediction").cast("string")
        return pred.groupBy(*by).agg(F.avg(same.cast("double")).alias("score"))
    y = F.col(label).cast("double")
    return pred.groupBy(*by).agg(
        (1 - F.sum(F.pow(y - F.col("prediction"), 2)) / (F.count(y) * F.var_pop(y))).alias("score"))


#: Rows of permuted copies that one job pairs and scores, and rows of a part of a hash order.
PAIRED, PART = 2_000_000, 100_000


def _paired(df: DataFrame, n: int, copies: dict[int, str], id_col: str, seed: int) -> DataFrame:
    """The n rows of ``df`` once for each of ``copies`` (number ``__copy`` ->
    feature), that feature's values dealt out anew: the row at a place in one
    hash order gets the value of the row at that place in another.

    A hash order is cut into parts at fixed hashes, which are even as hashes
    are; a place is the row's number in its part after the rows of the parts
    before, so no row is lost or met twice."""
    used, parts = list(dict.fromkeys(copies.values())), -(-n // PART)
    ex = df.select("*", F.explode(F.array(*[F.lit(i) for i in copies])).alias("__copy"))
    before = Window.partitionBy("__copy").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__copy", "__part").orderBy("__h", id_col)

    def placed(rows: DataFrame, salt: int) -> DataFrame:
        rows = rows.withColumn("__h", F.xxhash64(F.col(id_col), F.col("__copy"), F.lit(salt))) \
            .withColumn("__part", F.floor((F.shiftright("__h", 32) + (1 << 31)) * parts / (1 << 32)))
        sizes = rows.groupBy("__copy", "__part").agg(F.count(F.lit(1)).alias("__n"))
        starts = sizes.select("__copy", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
        return rows.withColumn("__pos", F.row_number().over(inside)).join(F.broadcast(starts), ["__copy", "__part"]) \
            .withColumn("__pos", F.col("__pos") + F.col("__start")).drop("__h", "__part", "__start")

    vals = placed(ex.select("__copy", id_col, *used), seed + 7919) \
        .select("__copy", "__pos", *[F.col(f).alias(f"__val{i}") for i, f in enumerate(used)])
    j = placed(ex, seed).join(vals, ["__copy", "__pos"])
    for i, f in enumerate(used):
        mine = F.col("__copy").isin([c for c, g in copies.items() if g == f])
        j = j.withColumn(f, F.when(mine, F.col(f"__val{i}")).otherwise(F.col(f)))
    return j.select(*df.columns, "__copy")


def _tree_cells(model, rows: DataFrame, label: str) -> tuple[DataFrame, list[str], PipelineModel, DL.Cells] | None:
    """(encoded rows, the assembler's inputs, stages from the tree model on,
    cells) of a pipeline whose tree model reads plain numbers, each made from one
    feature; None for any other."""
    if not isinstance(model, PipelineModel) or not any(hasattr(s, "featureImportances") for s in model.stages):
        return None
    pre, tree = _split_model(model)
    if pre is None or not isinstance(pre.stages[-1], VectorAssembler) or pre.stages[-1].getOutputCol() != tree.getFeaturesCol():
        return None
    encoded, inputs = PipelineModel(pre.stages[:-1]).transform(rows), pre.stages[-1].getInputCols()
    if any(encoded.schema[c].dataType != T.DoubleType() for c in inputs):
        return None
    nodes = tree_table(tree)[0]
    nodes = nodes[nodes["leftChild"] >= 0]
    if (nodes["ncat"] > 0).any():
        return None
    cuts = [np.unique([c[0] for c in nodes.loc[nodes["feature"] == i, "cats"]]) for i in range(len(inputs))]
    labels = [r[0] for r in rows.select(F.col(label).cast("string").alias("c")).where("c is not null").distinct().limit(DL.LABELS + 1).collect()]
    cells = DL.Cells(cuts, sorted(labels))
    return (encoded, inputs, PipelineModel(model.stages[len(pre.stages):]), cells) if cells.fits() else None


def _feature_input(feature: str, inputs: Sequence[str]) -> int | None:
    """The place of the one input that ``models.feature_stages`` makes from a feature."""
    own = [i for i, c in enumerate(inputs) if c in (feature, f"{feature}__full", f"{feature}__code")]
    return own[0] if len(own) == 1 else None


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str,
                           id_col: str, task: str = "classification", repeats: int = 5,
                           seed: int = 42) -> DataFrame:
    """``(feature, importance, std)`` = base score − score with the
    feature's column permuted, mean and std over ``repeats``, highest
    first.  ``label`` must be in the model's own label space (for a
    classification PipelineModel from ``fit_scoring_model``, compare
    ``predicted_label`` with the raw target).

    Copies are scored some at a time (``PAIRED`` rows, one copy at least) and
    each job's shuffle files go with it, so that the disk in use grows with
    the rows, not with rows times copies."""
    spark = df.sparkSession
    feats = list(features)
    copies = dict(enumerate(f for f in feats for _ in range(repeats)))

    def predicted(stacked: DataFrame, stages: PipelineModel) -> DataFrame:
        pred = stages.transform(stacked)
        pcol = "predicted_label" if "predicted_label" in pred.columns else "prediction"
        if pcol != "prediction":
            pred = pred.drop("prediction").withColumnRenamed(pcol, "prediction")
        return pred

    def scores(stacked: DataFrame) -> list:
        return _score(predicted(stacked, model), label, task, ["__copy"]).select("__copy", F.col("score").cast("double")).collect()

    def all_scores() -> list:
        known = _tree_cells(model, df, label) if task == "classification" else None
        if known:
            encoded, inputs, tail, cells = known
            of = {c: _feature_input(f, inputs) for c, f in copies.items()}
            if None not in of.values():
                hit = F.col("__y") == F.col("prediction").cast("string")
                return DL.scores(encoded, inputs, label, id_col, cells, of, seed,
                                 lambda counted: predicted(cells.rows(counted, tail.stages[0].getFeaturesCol(), "__y"), tail).withColumn("hit", hit))
        rows = df.persist()
        n = rows.count()
        try:
            at_once = max(1, PAIRED // max(n, 1))
            found = scores(rows.withColumn("__copy", F.lit(-1)))
            for lo in range(0, len(copies), at_once):
                found += scores(_paired(rows, n, dict(list(copies.items())[lo:lo + at_once]), id_col, seed))
            return found
        finally:
            rows.unpersist()

    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")  # a job's shuffle files are not needed after it
    try:
        found = all_scores()
    finally:
        if before is None:
            spark.conf.unset(cleanup)
        else:
            spark.conf.set(cleanup, before)
    got = spark.createDataFrame([tuple(r) for r in found], "__copy int, score double")
    base = got.where(F.col("__copy") == -1).select(F.col("score").alias("__base"))
    cmap = F.create_map(*[x for i, f in copies.items() for x in (F.lit(i), F.lit(f))])
    per = got.where(F.col("__copy") >= 0).crossJoin(F.broadcast(base)) \
        .select(cmap[F.col("__copy")].alias("feature"), (F.col("__base") - F.col("score")).alias("drop"))
    return per.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std")) \
        .orderBy(F.desc("importance"))


# --------------------------------------------------------------------------
# X5 local surrogate
# --------------------------------------------------------------------------

def lime_rows(model: PipelineModel, train: DataFrame, rows: DataFrame, features: Sequence[str], id_col: str,
              n: int = 5000, top: int = 5, seed: int = 42, kernel_width: float | None = None) -> DataFrame:
    """Local linear explanation of each row in ``rows`` for its
    predicted class: ``(id, feature, weight, rank)`` for the ``top``
    features by |weight|.

    Numeric features are quartile-binned on ``train`` (discretised
    explanation); a perturbation draws each feature's bin by its train
    frequency and a value uniformly inside the bin; the interpretable
    input is "same bin as the row"; samples are weighted by an exponential
    kernel of width 0.75·√p on that binary space; ridge (α = 1) per row.
    """
    feats = list(features)
    p = len(feats)
    kw = kernel_width or 0.75 * math.sqrt(p)
    # per feature: quartile edges, bin frequencies and bin ranges (train)
    q = train.agg(*[F.percentile_approx(F.col(f).cast("double"), [0.25, 0.5, 0.75], 10000).alias(f"q{i}")
                    for i, f in enumerate(feats)]).first()
    edges = [sorted(set(q[f"q{i}"])) for i in range(p)]

    def bin_of(i, col):
        e = edges[i]
        expr = F.lit(0)
        for k, v in enumerate(e):
            expr = F.when(col > F.lit(v), F.lit(k + 1)).otherwise(expr)
        return expr

    tb = train.select(*[bin_of(i, F.col(f).cast("double")).alias(f"b{i}") for i, f in enumerate(feats)],
                      *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(feats)])
    # the bins of all features from one pass
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b{i}").alias("b"), F.col(f"x{i}").alias("x")) for i in range(p)])
    found = tb.select(F.inline(cells)).groupBy("i", "b").agg(
        F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i", "b").collect()
    stats = []
    for i in range(p):
        st = [r for r in found if r["i"] == i]
        tot = sum(r["c"] for r in st)
        stats.append([(r["b"], r["c"] / tot, r["lo"], r["hi"]) for r in st])
    spark = rows.sparkSession
    chosen = rows.select(id_col, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(feats)],
                         *[bin_of(i, F.col(f).cast("double")).alias(f"rb{i}") for i, f in enumerate(feats)])
    samples = spread(chosen).crossJoin(spark.range(n).withColumnRenamed("id", "__s"))
    cols = []
    for i in range(p):
        u = F.rand(seed + i)
        cum = 0.0
        bexpr = None
        for (b, share, lo, hi) in stats[i]:
            cum += share
            bexpr = F.when(u <= F.lit(cum), F.lit(b)) if bexpr is None else bexpr.when(u <= F.lit(cum), F.lit(b))
        bexpr = bexpr.otherwise(F.lit(stats[i][-1][0]))
        cols.append(bexpr.alias(f"sb{i}"))
    s = samples.select("*", *cols)
    for i in range(p):
        lo_map = F.create_map(*[x for (b, _, lo, _) in stats[i] for x in (F.lit(b), F.lit(lo))])
        hi_map = F.create_map(*[x for (b, _, _, hi) in stats[i] for x in (F.lit(b), F.lit(hi))])
        v = lo_map[F.col(f"sb{i}")] + F.rand(seed + 100 + i) * (hi_map[F.col(f"sb{i}")] - lo_map[F.col(f"sb{i}")])
        # sample 0 of every row is the row itself
        s = s.withColumn(feats[i], F.when(F.col("__s") == 0, F.col(f"x{i}")).otherwise(v)) \
             .withColumn(f"z{i}", F.when(F.col("__s") == 0, F.lit(1.0))
                         .otherwise((F.col(f"sb{i}") == F.col(f"rb{i}")).cast("double")))
    # keep non-feature columns the model may need (none by default)
    pred = model.transform(s.select(id_col, "__s", *feats, *[f"z{i}" for i in range(p)]))
    prob = vector_to_array("probability") if "probability" in pred.columns else None
    if prob is not None:
        w0 = Window.partitionBy(id_col)
        pred = pred.withColumn("__cls", F.first(F.when(F.col("__s") == 0, F.col("prediction")), True).over(w0)) \
            .withColumn("__y", prob[F.col("__cls").cast("int")])
    else:
        pred = pred.withColumn("__y", F.col("prediction"))
    d2 = sum(((1.0 - F.col(f"z{i}")) ** 2 for i in range(p)), F.lit(0.0))
    pred = pred.withColumn("__w", F.sqrt(F.exp(-d2 / (kw * kw))))
    id_type = rows.schema[id_col].dataType

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        Z = pdf[[f"z{i}" for i in range(p)]].to_numpy(dtype=np.float64)
        y = pdf["__y"].to_numpy(dtype=np.float64)
        w = pdf["__w"].to_numpy(dtype=np.float64)
        Xa = np.column_stack([Z, np.ones(len(Z))])
        sw = np.sqrt(w)[:, None]
        A = (Xa * sw).T @ (Xa * sw) + np.diag([1.0] * p + [0.0])
        coef = np.linalg.solve(A, (Xa * sw).T @ (y * sw[:, 0]))[:p]
        order = np.argsort(-np.abs(coef))[:top]
        return pd.DataFrame({id_col: [pdf[id_col].iloc[0]] * len(order),
                             "feature": [feats[k] for k in order], "weight": coef[order],
                             "rank": np.arange(1, len(order) + 1, dtype=np.int32)})

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("feature", T.StringType()),
                           T.StructField("weight", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    return pred.select(id_col, "__y", "__w", *[f"z{i}" for i in range(p)]).groupBy(id_col).applyInPandas(fit, schema)
