"""DBSCAN against brute force, isolation forest properties."""
import numpy as np
import pandas as pd

from tessera.operators import anomaly as AN


def _two_moons(n=500, seed=0):
    rng = np.random.RandomState(seed)
    t = rng.rand(n) * np.pi
    a = np.c_[np.cos(t[: n // 2]), np.sin(t[: n // 2])]
    b = np.c_[1 - np.cos(t[n // 2:]), 0.5 - np.sin(t[n // 2:])]
    pts = np.vstack([a, b]) * 3 + rng.randn(n, 2) * 0.35
    return pd.DataFrame({"id": np.arange(n), "x": pts[:, 0], "y": pts[:, 1]})


def _brute(pdf, eps, min_pts):
    X = pdf[["x", "y"]].to_numpy()
    d2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    nb = d2 <= eps * eps
    core = nb.sum(1) >= min_pts
    noise = ~core & ~(nb & core[None, :]).any(1)
    # components of core points
    n = len(X)
    lab = -np.ones(n, dtype=int)
    for i in np.flatnonzero(core):
        if lab[i] >= 0:
            continue
        stack = [i]
        lab[i] = i
        while stack:
            j = stack.pop()
            for k in np.flatnonzero(nb[j] & core):
                if lab[k] < 0:
                    lab[k] = i
                    stack.append(k)
    return core, noise, lab, nb


def test_dbscan_noise_equals_brute_force(spark):
    pdf = _two_moons()
    _, noise, _, _ = _brute(pdf, 0.5, 5)
    got = {r["id"] for r in AN.dbscan_noise(spark.createDataFrame(pdf), "id", ["x", "y"], 0.5, 5).collect()}
    assert got == set(pdf.id[noise])
    assert 0 < len(got) < len(pdf)


def test_dbscan_labels_partition_equals_brute_force(spark):
    pdf = _two_moons(300, 1)
    core, noise, lab, nb = _brute(pdf, 0.5, 5)
    got = AN.dbscan_labels(spark.createDataFrame(pdf), "id", ["x", "y"], 0.5, 5).toPandas().set_index("id")
    assert set(got.index[got.cluster == -1]) == set(pdf.id[noise])
    # same partition of core points
    ci = np.flatnonzero(core)
    mine = got.loc[ci, "cluster"].to_numpy()
    for a in ci[:60]:
        same_ref = lab[ci] == lab[a]
        same_mine = mine == got.loc[a, "cluster"]
        assert (same_ref == same_mine).all()


def test_isolation_forest_finds_planted_points(spark):
    rng = np.random.RandomState(0)
    near = rng.randn(400, 2)
    far = np.array([[9, 9], [-9, 8], [10, -10], [-8, -9], [12, 0]], dtype=float)
    X = np.vstack([near, far])
    pdf = pd.DataFrame({"id": np.arange(len(X)), "x": X[:, 0], "y": X[:, 1]})
    out = AN.isolation_forest(spark.createDataFrame(pdf), ["x", "y"], id_col="id", contamination=0.05,
                              exact_threshold=True)
    got = {r["id"] for r in out.collect()}
    assert set(range(400, 405)) <= got
    assert abs(len(got) - 0.05 * len(X)) <= 2


def _blobs(seed=4):
    rng = np.random.RandomState(seed)
    a = rng.randn(150, 2) * 0.05 + [0, 0]        # dense: many points per sub-cell
    b = rng.randn(150, 2) * 0.05 + [0.6, 0.1]    # dense, linked to a through a bridge
    bridge = np.c_[np.linspace(0.05, 0.55, 12), np.linspace(0, 0.1, 12)]
    c = rng.randn(100, 2) * 0.08 + [5, 5]        # separate dense cluster
    sparse = rng.uniform(-3, 8, size=(60, 2))     # mostly noise
    X = np.vstack([a, b, bridge, c, sparse])
    return pd.DataFrame({"id": np.arange(len(X)), "x": X[:, 0], "y": X[:, 1]})


def test_dbscan_dense_cells_equal_brute_force(spark):
    pdf = _blobs()
    core, noise, lab, _ = _brute(pdf, 0.3, 5)
    df = spark.createDataFrame(pdf)
    got_noise = {r["id"] for r in AN.dbscan_noise(df, "id", ["x", "y"], 0.3, 5).collect()}
    assert got_noise == set(pdf.id[noise])
    got = AN.dbscan_labels(df, "id", ["x", "y"], 0.3, 5).toPandas().set_index("id")
    ci = np.flatnonzero(core)
    mine = got.loc[ci, "cluster"].to_numpy()
    ref = lab[ci]
    # identical partitions of the core points
    pairs_ref = {(a, b) for a in set(ref) for b in set(mine[ref == a])}
    assert len(pairs_ref) == len(set(ref)) == len(set(mine))
