"""Periodic runs against brute force over all periods."""
import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from tessera.llm import periods, queries


def brute_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s >= q:
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= least)


def plant(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = words if doc_id is None else plant(doc_id, words)
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def found(words, least=1):
    return periods._runs_of([[str(w).encode() for w in words]], least)[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 40), st.integers(1, 6))
def test_short_alphabets(words, cut, times):
    words = words[:cut] * times + words[cut:]
    assert found(words) == brute_runs(words, 1)


def test_nested_and_junction_runs():
    rng = random.Random(5)
    for _ in range(120):
        d = rng.choice([1, 2, 3, 5])
        root = [rng.randrange(3) for _ in range(d)]
        u = (root * 60)[:rng.randint(16, 140)]
        v = u[rng.randrange(d):] + ([9] if rng.random() < .3 else [])
        words = (u + v) * rng.choice([1, 2, 3]) + [rng.randrange(4) for _ in range(rng.randrange(30))]
        words = words[:rng.randint(20, len(words))]
        assert found(words) == brute_runs(words, 1)
    for depth in range(1, 9):  # Fibonacci words hold a great many runs
        a, b = [0], [0, 1]
        for _ in range(depth + 3):
            a, b = b, b + a
        assert found(b) == brute_runs(b, 1)


def test_long_periods_and_blocks_of_texts():
    rng = random.Random(6)
    texts = []
    for n in (0, 1, 30, 700, 90, 2500, 11):
        w = [str(rng.randrange(50)) for _ in range(n)]
        p = rng.randint(1, max(1, n // 2))
        texts.append((w[:p] * 4)[:n] + w[: n // 3])
    got = periods._runs_of([[w.encode() for w in t] for t in texts], 12)
    assert got == [brute_runs(t) for t in texts]
    same = np.zeros(200_000, np.int64).astype(str).tolist()
    assert found(same, 12) == [(0, 200_000, 1)]
    mixed = ([str(i) for i in range(33)] * 8000)[:250_000]
    assert found(mixed, 12) == [(0, 250_000, 33)]


def test_documents_match_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF_SMALL).collect()}
    assert set(got) == set(docs) and sum(g[0] > 0 for g in got.values()) > 15
    for d, text in docs.items():
        words = plant(d, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        if len(words) < 1500:
            assert got[d] == contract(d, text), d


def test_odd_rows(spark, tmp_path):
    run = " ".join(["a", "b\u00a0c", "d"] * 5)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, run), (4, run), (4, "a a"), (None, run), (None, None), (5, run + " " + run),
            (41, "x " * 11), (42, "x " * 12)]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, start int, runs string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(repr, (tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())))
    assert got == sorted(repr((i, *contract(i, t))) for i, t in rows)
    real = {r["doc_id"]: r for r in periods.periodic_runs(df).where("doc_id = 5").collect()}[5]
    assert real["n_words"] == 30 and [tuple(r) for r in real["runs"]] == [(0, 30, 3)] and real["collapsed"] == "a b\u00a0c d"
    assert periods.periodic_runs(df.limit(0)).count() == 0
    odd = df.select(df.doc_id.cast("int").alias("my.id"), df.text.alias("my text"))
    assert periods.periodic_runs(odd, "my.id", "my text").count() == len(rows)
