"""The corpus pipeline, stage by stage against brute force."""
import re
import sys

from conftest import ROOT, SF_SMALL
from llm_reference import brute_components, reference_fingerprint
from tessera.llm import pieces

sys.path.insert(0, ROOT)
import corpus_pipeline as P  # noqa: E402


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()}
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        columns = docs.columns
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name != "encoding":
            assert docs.columns == columns
        if name not in ("pii", "encoding"):
            assert all(after[d] == before[d] for d in after)
        if name == "language_id":
            assert all(any(c.isalpha() for c in after[d]["text"]) for d in after) and len(after) >= 0.98 * len(before)
        elif name == "near_dedup":
            roots = brute_components({d: reference_fingerprint(r["text"]) for d, r in before.items()}, 3)
            assert set(after) == {d for d, c in roots.items() if c == d}
        elif name == "decontamination":
            words = {d: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", r["text"].lower())) for d, r in before.items()}
            items = [" ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) for t in bench.values()]
            leaks = {d for d, w in words.items() if any(i in w for i in items)}
            assert leaks and set(after) == set(before) - leaks
        elif name == "pii":
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
            found = {m for r in before.values() for m in re.findall(r"\S+@\S+\w|\b\d{16}\b", r["text"])}
            assert found and not any(m in r["text"] for r in after.values() for m in found)
        else:
            v = pieces.load_vocabulary()
            assert all(pieces.decode_ids(v, r["ids"]) == before[d]["text"] and r["round_trip"] for d, r in after.items())
    assert P.run(spark, SF_SMALL).count() == len(after)


def test_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_odd_rows(spark, tmp_path):
    rows = [(None, "the of and to in that", "en", "s", 1), (None, "the of and to in that", "en", "s", 1), (5, None, None, None, None),
            (6, "", None, None, None), (7, "the and of me@x.org with", None, "s", 2), (7, "the and of me@x.org with", None, "s", 2)]
    rows += [(10 + i, f"the and of to in is that was {i} for it with", "en", "s", 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = [r["doc_id"] for r in docs.collect()]
    assert ids.count(7) == 1 and ids.count(None) == 1 and not {5, 6} & set(ids)


def test_survivors_of_repeated_ids(spark):
    a, b = "one two three four five six seven eight", "words of quite another kind that stand alone here"
    rows = [(1, a), (5, a), (5, b), (9, b + " x"), (9, "z " + a), (3, b + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    prints = {t: reference_fingerprint(t) for _, t in rows}
    far = {t for t in prints if all(t == u or (prints[t] ^ prints[u]).bit_count() > 3 for u in prints)}
    assert far == set(prints)  # only equal texts are near here
    out = sorted((r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs, "").collect())
    assert out == sorted([(1, a), (5, b), (3, b + " x"), (9, "z " + a)])


def test_language_id_rejects_what_no_model_fits(spark):
    import random
    rng = random.Random(1)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = [(10_000, "".join(rng.choices("qwxzjkvbpfgmhy", k=200)), None, "s", 1), (10_001, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 20, None, "s", 1)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = {r["doc_id"] for r in P.language_id(spark, both, SF_SMALL).select("doc_id").collect()}
    assert not kept & {10_000, 10_001} and len(kept) >= 0.98 * docs.count()
