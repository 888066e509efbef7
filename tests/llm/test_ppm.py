"""Language id: exact code lengths against a plain sequential coder, and
held-out accuracy."""
import math
import zlib
from collections import Counter, defaultdict

import pytest

from conftest import SF_MID
from tessera.llm import ppm


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    return ppm.train(docs.where(~ppm.held_out()), order=3, sample_per_lang=40, max_contexts=400)


def plain_bits(counts, text, order, known):
    """Code length of a text, byte by byte, with escapes and exclusion."""
    data, bits = text.encode(), 0.0
    for i, byte in enumerate(data):
        k = min(order, i)
        while data[i - k:i] not in known:
            k -= 1
        seen, left = set(), 1.0
        while k >= 0:
            here = {s: n for s, n in counts[data[i - k:i]].items() if s not in seen}
            n, q = sum(here.values()), len(here)
            if n:
                if byte in here:
                    left *= here[byte] / (n + q)
                    break
                left *= q / (n + q)
                seen |= set(here)
            k -= 1
        else:
            left /= 256 - len(seen)
        bits -= math.log2(left)
    return bits


def test_code_lengths(spark):
    texts = {"aa": "abracadabra abba", "bb": "bcbcbcd ébc"}
    train = spark.createDataFrame([(i, t, la) for i, (la, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    m = ppm.train(train, order=2, sample_per_lang=9, max_contexts=1000)
    assert m.langs == ["aa", "bb"]
    known, counts = {b""}, {la: defaultdict(Counter) for la in texts}
    for la, t in texts.items():
        d = t.encode()
        for i in range(len(d)):
            for k in range(min(2, i) + 1):
                counts[la][d[i - k:i]][d[i]] += 1
                known.add(d[i - k:i])
    probes = ["abra", "bcd", "zé\n", "a", "", "abracadabra abba" * 3]
    got = m.code_lengths(probes)
    for row, text in zip(got, probes):
        for x, la in zip(row, m.langs):
            assert x == pytest.approx(plain_bits(counts[la], text, 2, known), rel=1e-5, abs=1e-4)


def test_blocks_do_not_change_results(model, monkeypatch):
    texts = ["the of and " * 40, "", "der die das", "é" * 50]
    whole = model.code_lengths(texts)
    monkeypatch.setattr(ppm, "BLOCK", 7)
    assert model.code_lengths(texts) == pytest.approx(whole)


def test_probabilities_sum_to_one(model):
    assert (2.0 ** -model.bits.astype("f8")).sum(1) == pytest.approx(1, abs=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    out = ppm.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_edge_rows(spark):
    rows = [(i, "the and of with", "en", "x", 0.0) for i in range(40)] + [(50 + i, "der und die das", "de", "x", 0.0) for i in range(40)]
    rows += [(200, None, "en", "x", 0.0), (201, "", "en", "x", 0.0), (202, "12 %", "en", "x", 0.0), (None, "und das die", None, "x", 0.0),
             (203, "the of " * 30_000, None, "x", 0.0), (203, "the of", None, "x", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, score double")
    out = {(r["doc_id"], r["lang_pred"]): r["score"] for r in ppm.identify(df).collect()}
    assert {x for x in out if x[0] is None or x[0] > 199} == {(200, "und"), (201, "und"), (202, "und"), (None, "de"), (203, "en")}
    assert out[200, "und"] == 0 and ppm.identify(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", df["lang"].substr(9, 1)).where("lang is null")
    assert {r["lang_pred"] for r in ppm.identify(unlabelled).collect()} <= {"und"}
