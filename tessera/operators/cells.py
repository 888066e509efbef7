"""Forests of classes and bounded depth, grown on counted cells.

A tree over binned features sees a row only as its bins and its class.  Rows
that share these are one cell; cells are counted in one pass, and there are at
most bins^features x classes of them, however many the rows, and never more
than rows.  A tree's bag draws Poisson(1) for a row, so it holds Poisson(n) of
a cell of n rows, and the trees are drawn from the same distribution as on the
rows.  A level of all trees is one pass over the cells that adds up histograms
by tree, node, feature, bin and class.

The rest is as in Spark's own forest (32 bins, Gini gain, square root of the
features in a node, pruning of leaves that predict alike), and the result is a
Spark model, read from files of its own format.  Draws are seeded by the
cells' bucket, which depends on the data alone.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import named
from tessera.operators.forest import children_of, mixed, root_path
from tessera.session import ensure_checkpoint_dir, scratch_dir

#: Cells of a block; bytes of histograms that a task holds at most.
CELLS, HELD = 8192, 64 << 20
#: Features that cells are keyed by at most.
FEATURES_MOST = 64
#: Points of each feature's quantile sketch, which the cuts of its bins are chosen from.
POINTS = 2000


def suits(est, features: int, classes: int) -> bool:
    """Whether the estimator is a forest of this module's kind and a level's
    histograms of all its trees fit a task."""
    if not isinstance(est, RandomForestClassifier) or not 0 < features <= FEATURES_MOST or est.getMaxBins() > 256 or not 0 < est.getMaxDepth() <= 20:
        return False
    known = est.getImpurity() == "gini" and est.getFeatureSubsetStrategy() in ("auto", "sqrt", "all") and est.getMinInstancesPerNode() == 1 \
        and est.getMinInfoGain() == 0 and est.getMinWeightFractionPerNode() == 0 and est.getSubsamplingRate() == 1 and not est.isDefined("weightCol")
    leaves = 2 ** (est.getMaxDepth() - 1)
    return known and est.getNumTrees() * leaves * features * est.getMaxBins() * max(2, classes) * 8 <= HELD


def cuts_of(points: Sequence[float], bins: int) -> np.ndarray:
    """Thresholds of a feature as Spark chooses them from a sample, here from
    evenly spaced quantiles: between all values if there are few, else where
    the counts pass the strides of ``bins`` equal parts."""
    values, counts = np.unique(np.array(points, np.float64), return_counts=True)
    mids = values[:-1] / 2 + values[1:] / 2
    if len(mids) >= bins:
        got, target, stride, total = [], counts.sum() / bins, counts.sum() / bins, int(counts[0])
        for i in range(1, len(values)):
            before, total = total, total + int(counts[i])
            if abs(before - target) < abs(total - target):
                got.append(mids[i - 1])
                target += stride
        mids = np.array(got[:bins - 1])
    return np.unique(mids[~np.isnan(mids)])


def code_of(x: Column, cuts: np.ndarray) -> Column:
    """Number of cuts below x, by halving; a NaN is above all."""
    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(float(cuts[mid])), part(lo, mid)).otherwise(part(mid + 1, hi))
    return part(0, len(cuts)).cast("short")


NODES = "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, " \
        "gain: double, leftChild: int, rightChild: int, " \
        "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
BLOCK = "bucket int, n int, codes binary, label binary, rows binary"


def packed(cells: DataFrame, p: int) -> DataFrame:
    """Blocks of ``cells(c0.., label, n)``, about ``CELLS`` in each, in a checkpoint."""
    keys = [*[f"c{i}" for i in range(p)], "label"]
    cells = cells.persist()
    m = cells.count()
    buckets = max(1, -(-m // CELLS))
    slots = cells.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(held):
            pdf = pd.concat(held)
            return pd.DataFrame([{"bucket": int(pdf["bucket"].iat[0]), "n": len(pdf), "codes": pdf[keys[:-1]].to_numpy(np.uint8).tobytes(),
                                  "label": pdf["label"].to_numpy(np.int32).tobytes(), "rows": pdf["n"].to_numpy(np.int64).tobytes()}])

        held = []
        for pdf in batches:
            for b, part in pdf.groupby("bucket", sort=True):
                if held and int(held[0]["bucket"].iat[0]) != b:
                    yield block(held)
                    held = []
                held.append(part)
        if held:
            yield block(held)

    out = cells.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")) \
        .repartition(min(buckets, 4 * slots + m // 1_000_000), "bucket").sortWithinPartitions("bucket", *keys).mapInPandas(run, BLOCK).checkpoint()
    cells.unpersist()
    return out


def _gini(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.ones(n.shape)
    for k in range(counts.shape[-1]):
        share = np.divide(counts[..., k], n, out=np.zeros(n.shape), where=n > 0)
        out -= share * share
    return np.where(n > 0, out, 0.0)


def best_splits(hist: np.ndarray, paths: np.ndarray, tried: int, splits: np.ndarray):
    """(gain, feature, bin, counts left, counts of the node) of each node's best
    split, from ``hist`` (nodes, features, bins, classes); ``splits``: cuts of
    each feature.  A node looks at ``tried`` features, drawn by its path."""
    m, p, bins, k = hist.shape
    left = np.cumsum(hist, 2)
    whole = left[:, :, -1:, :]
    right = whole - left
    n, nl, nr = whole.sum(-1), left.sum(-1), right.sum(-1)
    safe = np.maximum(n, 1)
    gain = _gini(whole, n) - nl / safe * _gini(left, nl) - nr / safe * _gini(right, nr)
    ok = (nl > 0) & (nr > 0) & (np.arange(bins)[None, None, :] < splits[None, :, None])
    if tried < p:
        draw = mixed(paths[:, None] ^ mixed(np.arange(1, p + 1, dtype=np.uint64))[None, :])
        ok &= (np.argsort(np.argsort(draw, 1, kind="stable"), 1, kind="stable") < tried)[:, :, None]
    gain = np.where(ok, gain, -np.inf).reshape(m, -1)
    best, at = gain.argmax(1), np.arange(m)
    f, b = best // bins, best % bins
    return gain[at, best], f, b, left[at, f, b], whole[:, 0, 0]


class _Growing:
    """Nodes of a tree so far: lists by node."""

    def __init__(self, path: int):
        self.feature, self.upto, self.left, self.gain, self.counts, self.path = [-1], [0], [-1], [-1.0], [None], [path]
        self.open = [0]

    def split(self, node: int, gain: float, f: int, b: int, left: np.ndarray, whole: np.ndarray, last: bool) -> list[int]:
        """Children still to be split."""
        self.counts[node] = whole
        if not gain > 0:
            return []
        at = len(self.feature)
        self.feature[node], self.upto[node], self.left[node], self.gain[node] = f, b, at, gain
        ways, more = children_of(np.array([self.path[node]], np.uint64)), []
        for i, (counts, way) in enumerate(zip((left, whole - left), ways)):
            self.feature.append(-1), self.upto.append(0), self.left.append(-1), self.gain.append(-1.0)
            self.counts.append(counts), self.path.append(int(way[0]))
            if not last and np.count_nonzero(counts) > 1:
                more.append(at + i)
        return more


def grow(blocks: DataFrame, p: int, classes: int, splits: np.ndarray, trees: int, depth: int, tried: int, bins: int, seed: int,
         bag: bool = True) -> list[_Growing]:
    """All trees on the cells of ``blocks``, one pass a level; ``bag``: each on
    its own draws, else on the rows as they are."""
    grown = [_Growing(root_path(seed + 7_919 * t)) for t in range(trees)]
    for level in range(depth):
        wanted = {t: g.open for t, g in enumerate(grown) if g.open}
        if not wanted:
            break
        tops = {t: tuple(np.array(a, np.int64) for a in (grown[t].feature, grown[t].upto, grown[t].left)) for t in wanted}
        paths = {t: np.array([grown[t].path[i] for i in nodes], np.uint64) for t, nodes in wanted.items()}

        def histograms(batches):
            total = {t: np.zeros((p, (len(nodes) + 1) * bins * classes)) for t, nodes in wanted.items()}
            ranks, any_ = {}, False
            for t, nodes in wanted.items():  # rows in nodes that are done go to a place of their own
                ranks[t] = np.full(len(tops[t][0]), len(nodes))
                ranks[t][nodes] = np.arange(len(nodes))
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    any_ = True
                    codes = np.frombuffer(r.codes, np.uint8).reshape(r.n, p)
                    label, rows = np.frombuffer(r.label, np.int32), np.frombuffer(r.rows, np.int64)
                    flat, first = codes.ravel(), np.arange(r.n) * p
                    cells = [codes[:, f].astype(np.int64) * classes + label for f in range(p)]
                    if bag:
                        draws = np.random.Generator(np.random.PCG64([seed, r.bucket])).poisson(rows, (trees, r.n))
                    for t in wanted:
                        feature, upto, left = tops[t]
                        w, at = (draws[t] if bag else rows).astype(np.float64), np.zeros(r.n, np.int64)
                        for _ in range(level):
                            f = feature.take(at)
                            inner = f >= 0
                            at = np.where(inner, left.take(at) + (flat.take(first + np.maximum(f, 0)) > upto.take(at)), at)
                        base = ranks[t].take(at) * (bins * classes)
                        for f in range(p):
                            total[t][f] += np.bincount(base + cells[f], w, total[t].shape[1])
            if any_:
                yield pd.DataFrame({"tree": list(total), "hist": [v.tobytes() for v in total.values()]})

        def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
            t = int(pdf["tree"].iat[0])
            m = len(wanted[t])
            hist = sum(np.frombuffer(v) for v in pdf["hist"]).reshape(p, m + 1, bins, classes)[:, :m].transpose(1, 0, 2, 3)
            gain, f, b, left, whole = best_splits(hist, paths[t], tried, splits)
            return pd.DataFrame({"tree": t, "node": wanted[t], "gain": gain, "f": f, "b": b, "left": list(left), "whole": list(whole)})

        found = blocks.mapInPandas(histograms, "tree int, hist binary").groupBy("tree").applyInPandas(
            chosen, "tree int, node int, gain double, f int, b int, left array<double>, whole array<double>").collect()
        for g in grown:
            g.open = []
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            grown[r["tree"]].open += grown[r["tree"]].split(r["node"], r["gain"], r["f"], r["b"], np.array(r["left"]), np.array(r["whole"]),
                                                            level + 1 >= depth)
    return grown


def _nodes(tree: _Growing, cuts: Sequence[np.ndarray]) -> list[tuple]:
    """Rows of a tree's nodes as Spark stores them, numbered root first, then
    the left and the right subtree; leaves of one parent that predict the same
    class become one."""
    def part(node: int):
        counts = tree.counts[node]
        counts = np.zeros(1) if counts is None else counts
        if tree.feature[node] >= 0:
            a, b = part(tree.left[node]), part(tree.left[node] + 1)
            if len(a) > 1 or len(b) > 1 or a[0][0] != b[0][0]:
                return [(int(counts.argmax()), counts, tree.gain[node], tree.feature[node], tree.upto[node], len(a)), *a, *b]
        return [(int(counts.argmax()), counts, -1.0, -1, 0, 0)]

    out = []
    for i, (prediction, counts, gain, f, b, jump) in enumerate(part(0)):
        n = counts.sum()
        ways = (i + 1, i + 1 + jump) if f >= 0 else (-1, -1)
        split = (int(f), [float(cuts[f][b])], -1) if f >= 0 else (-1, [], -1)
        out.append((i, float(prediction), float(_gini(counts, np.asarray(n))), counts.tolist(), int(n), float(gain), *ways, split))
    return out


def _spark_model(spark, est: RandomForestClassifier, trees: list[list[tuple]], features: int, classes: int) -> RandomForestClassificationModel:
    """The model of node rows, by way of Spark's model files."""
    path = scratch_dir(spark, "forest")
    own = {q.name: v for q, v in est._paramMap.items()}
    default = {q.name: v for q, v in est._defaultParamMap.items()}
    head = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    whole = {"class": "org.apache.spark.ml.classification.RandomForestClassificationModel", **head, "uid": est.uid, "paramMap": own,
             "defaultParamMap": default, "numFeatures": features, "numClasses": classes, "numTrees": len(trees)}
    forest_only = ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")
    single = {"class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", **head,
              "paramMap": {k: v for k, v in own.items() if k not in forest_only},
              "defaultParamMap": {k: v for k, v in default.items() if k not in forest_only}}
    spark.sparkContext.parallelize([json.dumps(whole)], 1).saveAsTextFile(f"{path}/metadata")
    spark.createDataFrame([(t, json.dumps({**single, "uid": f"dtc_{est.uid}_{t}"}), 1.0) for t in range(len(trees))],
                          "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(t, n) for t, nodes in enumerate(trees) for n in nodes], NODES).coalesce(1).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def fit_forest(est: RandomForestClassifier, rows: DataFrame, inputs: Sequence[str], classes: int) -> RandomForestClassificationModel:
    """``est`` fitted on the numbers ``inputs`` of ``rows``, which hold the label as well."""
    ensure_checkpoint_dir(rows.sparkSession)
    bins, p = est.getMaxBins(), len(inputs)
    names = [f"c{i}" for i in range(p)]
    flat = rows.select(*[named(c).alias(n) for c, n in zip(inputs, names)], F.col(est.getLabelCol()).cast("int").alias("label"))
    cuts = [cuts_of(q, bins) for q in flat.approxQuantile(names, [i / POINTS for i in range(POINTS + 1)], 0.5 / POINTS)]
    cells = flat.select(*[code_of(F.col(n), c).alias(n) for n, c in zip(names, cuts)], "label").groupBy(*names, "label").agg(F.count(F.lit(1)).alias("n"))
    trees, strategy = est.getNumTrees(), est.getFeatureSubsetStrategy()
    tried = math.ceil(math.sqrt(p)) if strategy == "sqrt" or strategy == "auto" and trees > 1 else p
    grown = grow(packed(cells, p), p, classes, np.array([len(c) for c in cuts]), trees, est.getMaxDepth(), tried, bins,
                 est.getSeed() % (1 << 63), est.getBootstrap())
    return _spark_model(rows.sparkSession, est, [_nodes(g, cuts) for g in grown], p, classes)
