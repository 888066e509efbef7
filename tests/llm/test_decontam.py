"""Spaced-seed decontamination against brute force over all alignments."""
import math
import random
import re
from itertools import combinations

import pytest

from conftest import SF_SMALL
from tessera.llm import decontam


def words(t):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())


def brute(doc, item, window=13, identity=0.8):
    """Best (matched, overlap, first) over all diagonals, None if nothing passes."""
    d, x, best = words(doc), words(item), None
    w = min(window, len(x))
    for diag in range(-len(x) + 1, len(d)):
        same = [0 <= diag + j < len(d) and d[diag + j] == x[j] for j in range(len(x))]
        good = [j for j in range(len(x) - w + 1) if sum(same[j:j + w]) >= identity * w - 1e-9] if w else []
        if good:
            a, b = good[0], good[-1] + w
            got = (sum(same[a:b]), b - a, diag + a)
            best = got if best is None else max(best, got, key=lambda g: (g[0], -g[1], -g[2]))
    return best


def pairs(df):
    return {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_overlap"], r["first_word"]) for r in df.collect()}


def test_documents(spark):
    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    out = pairs(decontam.find_overlaps(docs, bench))
    texts, items = ({r[0]: r[1] for r in df.select(i, "text").collect()} for df, i in ((docs, "doc_id"), (bench, "item_id")))
    want = {}
    for d, t in texts.items():
        have = set(words(t))
        for i, x in items.items():  # too few common words cannot pass
            if sum(w in have for w in words(x)) >= 11 and (got := brute(t, x)):
                want[d, i] = got
    assert out == want and len(want) >= 3
    clean = docs.where(~decontam.contaminated(docs, bench))
    assert {r[0] for r in clean.select("doc_id").collect()} == set(texts) - {d for d, _ in want}


@pytest.fixture()
def planted(spark):
    rng = random.Random(6)
    vocab = ["w%d" % i for i in range(400)]
    items = {i: " ".join(rng.choices(vocab, k=rng.choice([3, 7, 12, 25, 60]))) for i in range(40)}
    texts = {}
    for d in range(200):
        body = rng.choices(vocab, k=rng.randint(0, 200))
        if d % 2:
            x = items[rng.randrange(40)].split()
            for _ in range(len(x) // 12):  # a substituted word in twelve
                x[rng.randrange(len(x))] = "zz"
            at = rng.randint(0, len(body))
            body[at:at] = x
        texts[d] = rng.choice([" ", ", ", "\n"]).join(body).upper()
    return texts, items


def test_substitutions(spark, planted):
    texts, items = planted
    docs = spark.createDataFrame([(d, t, d) for d, t in texts.items()], "doc_id long, text string, item int")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    out = pairs(decontam.find_overlaps(docs, bench))
    want = {(d, i): b for d, t in texts.items() for i, x in items.items() if (b := brute(t, x))}
    assert set(out) == set(want) and len(want) > 90
    assert sum(out[p] == want[p] for p in out) >= 0.97 * len(out)  # a better diagonal may hold no hit


def test_masks_meet_every_allowed_pattern(spark):
    for n in range(1, 19):
        wrong = n - math.ceil(0.8 * n - 1e-9)
        masks = decontam.complete_masks(n, wrong)
        for p in combinations(range(n), wrong):
            places = ((m, at) for m in masks for at in range(n - len(m) + 1))
            assert any(all(at + j not in p for j, bit in enumerate(m) if bit == "1") for m, at in places), (n, p)
    items = {n: " ".join(f"i{n}x{j}" for j in range(n)) for n in range(4, 16)}
    docs, d = [], 0
    for n, text in items.items():
        for p in combinations(range(min(n, 13)), min(n, 13) - math.ceil(0.8 * min(n, 13) - 1e-9)):
            docs.append((d, "start " + " ".join("XXX" if j in p else w for j, w in enumerate(text.split()[:13])) + " end", n, "c"))
            d += 1
    df = spark.createDataFrame(docs, "doc_id long, text string, n_matched int, first string")
    out = pairs(decontam.find_overlaps(df, spark.createDataFrame(list(items.items()), "item_id long, text string")))
    assert set(out) == {(d, n) for d, _, n, _ in docs}


def test_blocks_of_a_large_benchmark(spark, planted, monkeypatch):
    texts, items = planted
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    whole = pairs(decontam.find_overlaps(docs, bench))
    monkeypatch.setattr(decontam, "BENCHMARK_BLOCK", 3000)
    monkeypatch.setattr(decontam, "BLOCK", 500)
    monkeypatch.setattr(decontam, "CELLS", 50)
    assert pairs(decontam.find_overlaps(docs, bench)) == whole


def test_edge_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(3, item), (1, item), (4, None), (5, ""), (6, "!"), (None, "solo words")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "x " * 100_000 + item), (5, "solo, WORDS"), (6, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["first_word"]) for r in decontam.find_overlaps(docs, bench).collect())
    assert out == [(0, 1, 0), (3, 1, 0), (3, 1, 0), (4, 1, 100_000), (5, 0, 0)]
    assert decontam.find_overlaps(docs.limit(0), bench).count() == 0
    assert decontam.find_overlaps(docs, bench.limit(0)).count() == 0
    assert docs.where(~decontam.contaminated(docs, bench.limit(0))).count() == len(rows)
