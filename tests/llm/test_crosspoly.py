"""Cross-polytope near-duplicates against brute force over all pairs."""
import numpy as np

from conftest import SF_SMALL
from tessera.llm import crosspoly, queries
from tessera.plans.oracle_check import compare


def brute(rows, threshold=0.93):
    """id -> (links, component) for [(id, vector, label)]."""
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows
          if lab is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)]
    root, links = {i: i for i, *_ in rows}, {i: 0 for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a, la) in enumerate(ok):
        for j, b, lb in ok[:x]:
            if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: (links[i], find(i)) for i, *_ in rows}


def got(df):
    out = {}
    for r in df.collect():
        assert r["kept"] == (r["vec_id"] == r["component_id"])
        out[r["vec_id"]] = (r["n_links"], r["component_id"])
    return out


def planted(seed, n, clusters=12, d=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    out = []
    for i in range(n):
        noise = rng.choice([0.0, 0.05, 0.12, 0.2, 0.3, 3.0])
        v = centres[rng.integers(clusters)] + noise * rng.normal(size=d)
        out.append((i, v.astype(np.float32).tolist(), int(rng.integers(3))))
    return out


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_planted_clusters(spark):
    rows = planted(1, 500)
    out, want = got(crosspoly.near_duplicates(spark.createDataFrame(rows, SCHEMA))), brute(rows)
    links = sum(n for n, _ in want.values())
    found = sum(n for n, _ in out.values())
    assert links > 1000 and found <= links and found >= 0.99 * links
    assert all(out[i][0] <= want[i][0] for i in out)
    assert sum(out[i] == want[i] for i in out) >= 0.95 * len(rows)


def test_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(crosspoly.near_duplicates(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"))) == brute(rows)


def test_repeated_ids_on_other_vectors(spark):
    angle = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    rows = [(1, angle(0), 0), (1, angle(15), 0), (1, angle(100), 0), (2, angle(30), 0), (3, angle(110), 0), (4, angle(112), 0),
            (None, angle(200), 0), (None, angle(210), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    # within 21.6 degrees: 0-15, 15-30, 100-110, 100-112, 110-112 and the two without an id
    got_ = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in crosspoly.near_duplicates(df).collect())
    assert got_ == [(0, 1, 0), (0, 1, 0), (1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_sql_on_a_table_with_links(spark, tmp_path):
    rows = planted(2, 300) + [(900, None, 1), (901, [0.0] * 64, 1), (902, [1.0, None], 0), (903, planted(2, 1)[0][1], None)]
    for n, noise in enumerate((0.0, 0.01, 0.02)):  # far above the threshold: no hash loses these
        rows += [(1000 + 10 * n + j, [x * (1 + noise * (j % 3)) for x in rows[j][1]], rows[j][2]) for j in range(9)]
    clear = brute(rows, 0.93)
    sure = brute(rows, 0.97)
    rows = [r for r in rows if clear[r[0]] == sure[r[0]]]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    res = compare(queries.op3_cross_polytope(spark, str(tmp_path)), str(tmp_path), queries.OP3_SQL)
    assert res["match"], res
    assert sum(n for n, _ in brute(rows).values()) > 40


def test_split_blocks_count_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(crosspoly, "LANES", 32)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    rows = [(i, (centre + 0.05 * rng.normal(size=64)).astype(np.float32).tolist(), 7) for i in range(200)]
    rows += [(300 + i, rows[5][1], 7) for i in range(40)]  # equal vectors are one class
    out = got(crosspoly.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert out == {i: (239, 0) for i, *_ in rows}


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [1.0, inf], 0), (5, [None, 1.0], 0), (6, [], 0),
            (7, [1.0, 0.0], None), (9, [1.0, 0.0], 0), (8, [2.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.0], 1),
            (12, [-1.0, 0.0], 0), (13, [3e38, 0.0], 0), (14, [1e-40, 0.0], 0)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", n_links int, root string")
    out = got(crosspoly.near_duplicates(df))
    want = {i: (0, i) for i, *_ in rows} | {i: (3, 8) for i in (8, 9, 13, 14)}
    assert out == want
    assert crosspoly.near_duplicates(df.limit(0)).count() == 0
    again = crosspoly.near_duplicates(spark.createDataFrame([(1, [1.0], 0), (1, [1.0], 0), (None, [2.0], 0)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in again) == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    x = crosspoly.unit(rng.normal(size=(1500, 64)))
    z = rng.normal(size=x.shape)
    z = crosspoly.unit(z - (z * x).sum(1)[:, None] * x)
    a, b = (crosspoly.bucket_keys(v, 6, 2, 4) for v in (x, 0.93 * x + np.sqrt(1 - 0.93 ** 2) * z))
    assert ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1).mean() >= 0.99
    y = crosspoly.rotated(x, 3)
    assert np.allclose((y * y).sum(1), 1) and np.allclose(y[:9] @ y[:9].T, x[:9] @ x[:9].T)
