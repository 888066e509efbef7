"""Anomaly detection (N1 isolation forest, N2 DBSCAN noise, N3 DBSCAN labels).

DBSCAN noise is exact and needs no clustering: a point is *core* when at
least ``min_pts`` points (itself included) lie within ``eps``; it is
*noise* when it is not core and no core point lies within ``eps``.
Neighbours are found by an equi-join on grid cells of side ``eps`` (each
point probes its 3^k neighbouring cells), followed by the exact distance.
Points in a dense sub-cell (side eps/√d, ≥ min_pts points) are core without
any pair being formed, so pairs are only emitted for points outside dense
sub-cells.

The isolation forest (Liu, Ting & Zhou 2008) builds each tree from a hash
sample of at most ψ = 256 rows — one bounded group per tree in
``applyInPandas`` — and scores rows with a vectorised pandas UDF against
the broadcast forest (T × (2ψ-1) nodes at most).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import numeric_columns, spread
from tessera.functions.components import connected_components
from tessera.session import scratch_dir


# --------------------------------------------------------------------------
# DBSCAN noise
# --------------------------------------------------------------------------

def _grid_dims(cols: Sequence[str], max_dims: int = 3) -> list[int]:
    return list(range(min(len(cols), max_dims)))


def dbscan_pairs(df: DataFrame, id_col: str, cols: Sequence[str], eps: float = 0.5,
                 min_pts: int = 5, grid_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Shared first half of N2/N3: ``(points, pairs)``.

    ``points``: id, coordinates, ``dense`` (in a dense sub-cell).
    ``pairs``: ``(p, q, d2)`` for every p outside dense sub-cells and every q
    within eps (q = p included).
    """
    d = len(cols)
    xs = [F.col(c).cast("double") for c in cols]
    base = df.select(F.col(id_col).alias("__id"), *[x.alias(f"__x{i}") for i, x in enumerate(xs)]).na.drop()
    gcols = list(grid_cols) if grid_cols else [cols[i] for i in _grid_dims(cols)]
    gidx = [list(cols).index(c) for c in gcols]
    cell = [F.floor(F.col(f"__x{i}") / eps).cast("bigint") for i in gidx]
    sub = eps / math.sqrt(d)
    subcell = F.array(*[F.floor(F.col(f"__x{i}") / sub).cast("bigint") for i in range(d)])
    pts = base.select("*", F.array(*cell).alias("__cell"), subcell.alias("__sub"))
    dense_cells = pts.groupBy("__sub").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_pts)
    pts = pts.join(dense_cells.select("__sub", F.lit(True).alias("dense")), "__sub", "left") \
        .withColumn("dense", F.coalesce("dense", F.lit(False)))
    # probe side: points outside dense sub-cells, one row per neighbouring cell
    offsets = [list(o) for o in product((-1, 0, 1), repeat=len(gidx))]
    off = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])
    probe = pts.where(~F.col("dense")).select(
        F.col("__id").alias("p"), *[F.col(f"__x{i}").alias(f"__p{i}") for i in range(d)],
        F.explode(off).alias("__o"), F.col("__cell").alias("__pc"))
    probe = probe.select("*", F.zip_with("__pc", "__o", lambda a, b: a + b).alias("__cell")).drop("__o", "__pc")
    build = pts.select(F.col("__id").alias("q"), *[F.col(f"__x{i}").alias(f"__q{i}") for i in range(d)], "__cell")
    d2 = sum(((F.col(f"__p{i}") - F.col(f"__q{i}")) ** 2 for i in range(d)), F.lit(0.0))
    pairs = probe.join(build, "__cell").select("p", "q", d2.alias("d2")).where(F.col("d2") <= eps * eps)
    return pts.select("__id", *[f"__x{i}" for i in range(d)], "dense"), pairs


def dbscan_core(df: DataFrame, id_col: str, cols: Sequence[str], eps: float = 0.5,
                min_pts: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(flags, pairs)``: flags = ``(__id, core)`` for every point."""
    pts, pairs = dbscan_pairs(df, id_col, cols, eps, min_pts)
    counts = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("__nb"))
    flags = pts.join(counts, pts["__id"] == counts["p"], "left").select(
        "__id", (F.col("dense") | (F.coalesce("__nb", F.lit(0)) >= min_pts)).alias("core"))
    return flags, pairs


def dbscan_noise(df: DataFrame, id_col: str, cols: Sequence[str] | None = None, eps: float = 0.5,
                 min_pts: int = 5) -> DataFrame:
    """The input rows labelled noise (-1), with all their columns.

    Columns default to the numeric (non-boolean) ones, rows with a NULL in
    them are left out, coordinates are used raw (unscaled), as in the
    original."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[id_col])
    flags, pairs = dbscan_core(df, id_col, cols, eps, min_pts)
    core_q = flags.where("core").select(F.col("__id").alias("q"))
    has_core_nb = pairs.join(core_q, "q", "left_semi").select(F.col("p").alias("__id")).distinct()
    noise_ids = flags.where(~F.col("core")).join(has_core_nb, "__id", "left_anti").select("__id")
    return df.join(noise_ids, df[id_col] == noise_ids["__id"], "left_semi")


def dbscan_labels(df: DataFrame, id_col: str, cols: Sequence[str] | None = None, eps: float = 0.5,
                  min_pts: int = 5) -> DataFrame:
    """Cluster label per row ``(id, cluster)``, -1 for noise.

    Core points are linked through core-core pairs within eps (points of one
    dense sub-cell are linked through the sub-cell); connected components by
    alternating stars, which run until nothing changes.  A border point takes
    the smallest label among its core neighbours.  Cluster ids are the
    smallest id of the component.
    """
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[id_col])
    pts, pairs = dbscan_pairs(df, id_col, cols, eps, min_pts)
    counts = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("__nb"))
    flags = pts.join(counts, pts["__id"] == counts["p"], "left").select(
        "__id", *[c for c in pts.columns if c.startswith("__x")], "dense",
        (F.col("dense") | (F.coalesce("__nb", F.lit(0)) >= min_pts)).alias("core"))
    d = len(cols)
    sub = eps / math.sqrt(d)
    flags = flags.withColumn("__sub", F.array(*[F.floor(F.col(f"__x{i}") / sub).cast("bigint")
                                               for i in range(d)])).checkpoint()
    core = flags.where("core").select("__id", "dense", "__sub", *[f"__x{i}" for i in range(d)])
    # edges: core-core pairs (p outside dense sub-cells) ...
    cid = core.select(F.col("__id").alias("q"))
    e1 = pairs.join(cid, "q", "left_semi").join(core.select(F.col("__id").alias("p")), "p", "left_semi") \
        .select(F.col("p").alias("a"), F.col("q").alias("b"))
    # ... dense sub-cell members linked to the smallest member of the sub-cell
    rep = core.where("dense").groupBy("__sub").agg(F.min("__id").alias("__rep"))
    e2 = core.where("dense").join(rep, "__sub").select(F.col("__id").alias("a"), F.col("__rep").alias("b"))
    # ... and dense sub-cells to each other through representatives
    e3 = _dense_cell_links(core.where("dense"), d, eps)
    edges = e1.unionByName(e2).unionByName(e3)
    roots = connected_components(_written(edges))
    labels = core.select(F.col("__id").alias("a")).join(roots, F.col("a") == F.col("node"), "left") \
        .select("a", F.coalesce("root", "a").alias("lab"))
    core_lab = labels.select(F.col("a").alias("q"), F.col("lab"))
    border = pairs.join(core_lab, "q").groupBy("p").agg(F.min("lab").alias("__bl"))
    allp = flags.select("__id", "core").join(labels, flags["__id"] == labels["a"], "left") \
        .join(border, flags["__id"] == border["p"], "left")
    return allp.select(F.col("__id").alias(id_col),
                       F.coalesce("lab", "__bl", F.lit(-1)).cast("bigint").alias("cluster"))


def _written(df: DataFrame) -> DataFrame:
    """The rows through a table in the shared folder: unlike a checkpoint it
    also leaves behind the predicates of the plan, which the optimizer would
    otherwise carry into every round."""
    path = scratch_dir(df.sparkSession, "dbscan")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _dense_cell_links(dense: DataFrame, d: int, eps: float, max_dims: int = 3) -> DataFrame:
    """Links between representatives of dense sub-cells closer than eps.

    Bounding boxes meet over a coarse grid of side eps on the first
    ``max_dims`` columns (their lower corners differ by at most 2 eps an
    axis).  Boxes farther apart than eps cannot hold a pair, boxes whose
    farthest corners lie within eps surely do; for the rest only the points
    of either sub-cell within eps of the other's box are compared.
    """
    boxes = dense.groupBy("__sub").agg(F.min("__id").alias("__rep"),
                                       *[F.min(f"__x{i}").alias(f"__l{i}") for i in range(d)],
                                       *[F.max(f"__x{i}").alias(f"__h{i}") for i in range(d)])
    g = min(d, max_dims)
    boxes = boxes.withColumn("__cell", F.array(*[F.floor(F.col(f"__l{i}") / eps).cast("bigint") for i in range(g)]))
    off = F.array(*[F.array(*[F.lit(v) for v in o]) for o in product(range(-2, 3), repeat=g)])
    near = boxes.select("*", F.explode(off).alias("__o")) \
        .withColumn("__cell", F.zip_with("__cell", "__o", lambda x, y: x + y)).drop("__o").alias("p") \
        .join(boxes.alias("q"), F.col("p.__cell") == F.col("q.__cell")).where(F.col("p.__rep") < F.col("q.__rep"))
    low, high = (lambda t, i: F.col(f"{t}.__l{i}")), (lambda t, i: F.col(f"{t}.__h{i}"))
    gap = sum((F.pow(F.greatest(F.lit(0.0), low("p", i) - high("q", i), low("q", i) - high("p", i)), 2)
               for i in range(d)), F.lit(0.0))
    far = sum((F.pow(F.greatest(high("p", i) - low("q", i), high("q", i) - low("p", i)), 2)
               for i in range(d)), F.lit(0.0))
    near = near.where(gap <= eps * eps).select(
        F.col("p.__sub").alias("__s1"), F.col("q.__sub").alias("__s2"), F.col("p.__rep").alias("a"),
        F.col("q.__rep").alias("b"), (far <= eps * eps).alias("sure"),
        *[c for t, n in (("p", 1), ("q", 2)) for i in range(d) for c in (low(t, i).alias(f"__l{n}{i}"),
                                                                        high(t, i).alias(f"__h{n}{i}"))])
    near = _written(near)
    open_pairs = near.where(~F.col("sure"))

    def facing(mine: int, other: int, name: str) -> DataFrame:
        pts = dense.select(F.col("__sub").alias(f"__s{mine}"), *[F.col(f"__x{i}").alias(f"{name}{i}") for i in range(d)])
        away = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"__l{other}{i}") - F.col(f"{name}{i}"),
                                     F.col(f"{name}{i}") - F.col(f"__h{other}{i}")), 2) for i in range(d)), F.lit(0.0))
        return open_pairs.join(pts, f"__s{mine}").where(away <= eps * eps) \
            .select("a", "b", *[f"{name}{i}" for i in range(d)]).distinct()

    d2 = sum(((F.col(f"__a{i}") - F.col(f"__b{i}")) ** 2 for i in range(d)), F.lit(0.0))
    proved = facing(1, 2, "__a").join(facing(2, 1, "__b"), ["a", "b"]).where(d2 <= eps * eps).select("a", "b").distinct()
    return near.where("sure").select("a", "b").unionByName(proved)


# --------------------------------------------------------------------------
# Isolation forest
# --------------------------------------------------------------------------

def _c(m: float) -> float:
    """Average path length of an unsuccessful BST search over m points."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1.0) + 0.5772156649015329) - 2.0 * (m - 1.0) / m


def _c_vec(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    out = np.zeros_like(m)
    two = m == 2
    big = m > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(m[big] - 1.0) + 0.5772156649015329) - 2.0 * (m[big] - 1.0) / m[big]
    return out


NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()), T.StructField("depth", T.IntegerType())])


def _build_tree(pdf: pd.DataFrame, ncols: int, psi: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["__tree"].iloc[0])
    pdf = pdf.sort_values("__h").head(psi)
    x = pdf[[f"__x{i}" for i in range(ncols)]].to_numpy(dtype=np.float64)
    rng = np.random.RandomState((seed * 1000003 + tree) % (2 ** 32))
    limit = int(math.ceil(math.log2(max(psi, 2))))
    rows = []

    def grow(idx: np.ndarray, depth: int) -> int:
        me = len(rows)
        rows.append(None)
        sub = x[idx]
        if depth >= limit or len(idx) <= 1:
            rows[me] = (tree, me, -1, 0.0, -1, -1, len(idx), depth)
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            rows[me] = (tree, me, -1, 0.0, -1, -1, len(idx), depth)
            return me
        f = int(cand[rng.randint(len(cand))])
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        left = grow(idx[go_left], depth + 1)
        right = grow(idx[~go_left], depth + 1)
        rows[me] = (tree, me, f, t, left, right, len(idx), depth)
        return me

    grow(np.arange(len(x)), 0)
    return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])


def isolation_forest_fit(df: DataFrame, cols: Sequence[str], id_col: str | None = None,
                         trees: int = 100, sample: int = 256, seed: int = 42) -> tuple[dict, int]:
    """Build the forest.  Row→tree assignment is a hash of (id, tree), so
    each tree's group holds about 1.5ψ rows whatever the table size (the
    count is the only driver-side number); the ψ smallest hashes are kept."""
    xs = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)]
    rid = F.col(id_col) if id_col else F.xxhash64(*[F.col(c) for c in cols])
    base = df.select(rid.alias("__rid"), *xs).na.drop()
    n = base.count()
    psi = int(min(sample, n))
    if psi < 1:
        raise ValueError("no complete rows to fit an isolation forest")
    m = 1 << 30
    thr = int(min(m, math.ceil(m * min(1.0, 1.5 * psi / n + 16.0 / n))))
    tr = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                  lambda t: F.pmod(F.xxhash64(F.col("__rid"), t, F.lit(seed)), F.lit(m)) < thr)
    sampled = base.select("*", F.explode(tr).alias("__tree")) \
        .withColumn("__h", F.xxhash64(F.col("__rid"), F.col("__tree"), F.lit(seed + 1)))
    ncols = len(cols)
    nodes = sampled.groupBy("__tree").applyInPandas(
        lambda pdf: _build_tree(pdf, ncols, psi, seed), NODE_SCHEMA).toPandas()
    forest = {}
    for t, g in nodes.groupby("tree"):
        g = g.sort_values("node")
        forest[int(t)] = {k: g[k].to_numpy() for k in ("feature", "threshold", "left", "right", "size", "depth")}
    return forest, psi


def isolation_scores(df: DataFrame, cols: Sequence[str], forest: dict, psi: int,
                     out: str = "anomaly_score") -> DataFrame:
    """Score = 2^(−E[h(x)]/c(ψ)), h = depth of the reached leaf + c(leaf size);
    one pandas UDF over Arrow batches, numpy traversal level by level."""
    trees = list(forest.values())
    cpsi = _c(psi)

    @F.pandas_udf(T.DoubleType())
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=np.float64) for s in series])
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for tr in trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                feat = tr["feature"][node]
                inner = feat >= 0
                if not inner.any():
                    break
                fi = np.where(inner, feat, 0)
                go_left = x[rows, fi] < tr["threshold"][node]
                nxt = np.where(go_left, tr["left"][node], tr["right"][node])
                node = np.where(inner, nxt, node)
            total += tr["depth"][node] + _c_vec(tr["size"][node])
        return pd.Series(np.power(2.0, -(total / len(trees)) / cpsi))

    return df.withColumn(out, score(*[F.col(c).cast("double") for c in cols]))


def isolation_forest(df: DataFrame, cols: Sequence[str] | None = None, id_col: str | None = None,
                     contamination: float = 0.05, trees: int = 100, sample: int = 256,
                     seed: int = 42, exact_threshold: bool = False) -> DataFrame:
    """Rows whose isolation score is above the (1 - contamination)
    quantile of all scores, over complete rows of the numeric columns; the
    score column is kept.  The quantile is ``percentile_approx`` (bounded
    sketch) unless ``exact_threshold``."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[id_col] if id_col else [])
    forest, psi = isolation_forest_fit(df, cols, id_col, trees, sample, seed)
    scored = isolation_scores(spread(df.na.drop(subset=cols)), cols, forest, psi)
    q = 1.0 - contamination
    thr = scored.agg((F.percentile(F.col("anomaly_score"), F.lit(q)) if exact_threshold
                      else F.percentile_approx("anomaly_score", q, 100000)).alias("__thr"))
    return scored.crossJoin(F.broadcast(thr)).where(F.col("anomaly_score") > F.col("__thr")).drop("__thr")


__all__ = ["dbscan_noise", "dbscan_labels", "dbscan_pairs", "isolation_forest", "isolation_forest_fit",
           "isolation_scores"]
