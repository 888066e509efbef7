"""Adaptive dimension scan against brute force."""
import math

import numpy as np

from conftest import SF_MID
from tessera.llm import nearest, queries


def brute(rows, k=20, every=20):
    """{place of a query: [(score, id)]} over usable (id, vector) rows."""
    ok = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is not None and i % every == 0:
            found = [(-float(np.dot(np.array(v, float), np.array(w, float))), j is None, j or 0)
                     for b, (j, w) in enumerate(ok) if a != b and len(w) == len(v)]
            out.append((i, [(-s, None if none else j) for s, none, j in sorted(found)[:k]]))
    return out


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    return {q: [found[i] for i in sorted(found)] for q, found in out.items()}


def recall(got, want):
    hit = sum(len({j for _, j in got.get(q, [])} & {j for _, j in best}) for q, best in want)
    return hit / max(1, sum(len(best) for _, best in want))


def test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    got, want = lists(queries.op12_adaptive_scan(spark, SF_MID)), brute(rows)
    assert recall(got, want) >= 0.95 and set(got) == {q for q, _ in want}
    vec = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 20 and [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
        assert all(abs(s - float(vec[q] @ vec[j])) < 1e-12 and j != q for s, j in found)


def test_clusters_norms_hot_vector_and_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 64)  # closures carry the layout that the driver makes
    monkeypatch.setattr(nearest, "UNIT", 256)
    monkeypatch.setattr(nearest, "CHUNK", 40)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 48))
    x = np.concatenate([centres[rng.integers(0, 12, 1200)] + 0.3 * rng.standard_normal((1200, 48)), np.repeat(centres[:1], 600, 0)])
    x *= rng.lognormal(0, 0.7, (len(x), 1))
    x[1200:] = x[1200]
    ids = rng.permutation(len(x))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got, want = lists(nearest.search(df, lists=40)), brute(rows)
    assert recall(got, want) >= 0.9 and all(len(f) == 20 for f in got.values())
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[0], f[1]))
    again = lists(nearest.search(df.repartition(3), lists=40))
    assert recall(again, [(q, f) for q, f in got.items()]) > 0.97


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (20, [1.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (None, [1.0, 1.0]), (40, None),
            (60, []), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [nan, 1.0]), (140, [inf, 1.0]), (160, [1.0, 2.0, 3.0]),
            (-20, [-1e200, 1e-200]), (180, [5e-324, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    out = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.search(df).collect()]
    want = [(q, i + 1, j, s) for q, found in brute(rows) for i, (s, j) in enumerate(found)]
    assert sorted(map(repr, out)) == sorted(map(repr, want)) and len(want) > 20
    assert nearest.search(df.limit(0)).count() == 0
    assert nearest.search(df.where("vec_id = 3")).count() == 0
    odd = df.selectExpr("vec_id as `my.id`", "cast(embedding as array<float>) as `my vec`").where("`my.id` in (0, 3)")
    assert nearest.search(odd, "my.id", "my vec").count() == 2


def test_tests_abandon_most_candidates():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    index = nearest.Index(64, "<f8", 1.0)
    y, q = index.candidates(x), index.queries(x[:30])
    assert np.allclose(((q[:, None] - y[None]) ** 2).sum(2), 2 - 2 * x[:30] @ x.T, atol=1e-12)
    best = np.sort(((q[:, None] - y[None]) ** 2).sum(2), 1)[:, 20]
    part = ((q[:, None, :32] - y[None, :, :32]) ** 2).sum(2)
    gone = part > 32 / 65 * (1 + nearest.EPS / np.sqrt(32)) ** 2 * best[:, None]
    near = ((q[:, None] - y[None]) ** 2).sum(2) <= best[:, None]
    assert gone.mean() > 0.02 and (gone & near).sum() <= 0.02 * near.sum()
