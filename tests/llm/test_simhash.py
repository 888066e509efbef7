"""SimHash near-duplicates against brute force over all pairs."""
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm_reference import brute_components, reference_fingerprint
from tessera.llm import simhash


def got(df):
    return {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in df.collect()}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = got(simhash.near_duplicates(docs))
    want = {r["doc_id"]: reference_fingerprint(r["text"]) for r in docs.collect()}
    assert {i: f for i, (f, _) in out.items()} == want
    assert {i: c for i, (_, c) in out.items()} == brute_components(want, 3)
    assert len({c for _, c in out.values()}) < len(out)


def test_fingerprint_hash_is_the_engines_own(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("aé b c"))).first()[0]
    assert h & (1 << 64) - 1 == xxhash.xxh64_intdigest("aé b c".encode(), 42)


def test_edge_rows(spark):
    long = " ".join(random.Random(1).choices("abcdefgh", k=70_000))
    rows = [(5, None), (4, ""), (9, " \n"), (2, "one"), (3, "ONE"), (7, long), (7, long), (8, long + "."), (None, "one")]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, fp long, component_id string")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[5]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (4, 5, 9)} == {4}
    assert by[3]["component_id"] == by[2]["component_id"] == by[None]["component_id"] == 2
    assert by[8]["component_id"] == 7 and sum(r["doc_id"] == 7 for r in out) == 2
    assert by[7]["fingerprint"] == f"{reference_fingerprint(long):016x}"
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_distances(radius):
    rng = random.Random(radius)
    base = rng.getrandbits(63)
    values = [base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 9))) for _ in range(300)]
    planes = simhash.bit_planes(values)
    for q in values[:20]:
        live = simhash.within(planes, q, (1 << 300) - 1, radius)
        assert [live >> k & 1 for k in range(300)] == [int((q ^ v).bit_count() <= radius) for v in values]


def test_hot_bucket_is_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LANES", 64)
    rng = random.Random(3)
    prints = {i: (7 << 40) ^ sum(1 << b for b in rng.sample(range(26), rng.randint(1, 8))) for i in range(900)}
    distinct = {}
    for i, f in prints.items():
        distinct.setdefault(f, i)
    classes = spark.createDataFrame([(i, f) for f, i in distinct.items()], "id long, fp long")
    roots = dict((r[0], r[1]) for r in simhash.connected_components(simhash.links(classes)).collect())
    assert {i: roots.get(i, i) for i in distinct.values()} == brute_components({i: f for f, i in distinct.items()}, 3)
