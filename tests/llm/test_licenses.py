"""License scans against their SQL and a plain Python scan."""
import math
import re

from conftest import SF_SMALL
from tessera.llm import licenses
from tessera.plans.oracle_check import compare

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    best, more = 0.0, set()
    for label, template in licenses.TEMPLATES:
        t = set(licenses.words_of(template))
        width = math.ceil(licenses.SPREAD * len(licenses.words_of(template)))
        for i in range(len(words)):
            share = len(t & set(words[i:i + width])) / len(t)
            if share >= licenses.THRESHOLD:
                more.add(label)
                best = max(best, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | more)), 1.0 if base else best)


def rows(df):
    return sorted(((r["doc_id"], *[r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])
                   for r in df.collect()), key=str)


def test_matches_sql(spark):
    res = compare(licenses.scan(spark.read.parquet(f"{SF_SMALL}/documents.parquet")), SF_SMALL, licenses.oracle_sql())
    assert res["match"], res


def test_wrapped_notices_match_and_scattered_words_do_not(spark):
    wrap = lambda t, n: "\n * ".join(" ".join(t.split()[i:i + n]) for i in range(0, len(t.split()), n))
    texts = {label: "/* Copyright\n * " + wrap(t, 7) + "\n */ int main;" for label, t in licenses.TEMPLATES}
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    out = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(docs).collect()}
    assert all(label in out[i] for i, label in enumerate(texts))
    far = "released at noon under heavy rain, the old mit building and the license plate"
    long = " ".join(f"{w} {'and so on ' * 40}" for t in dict(licenses.TEMPLATES).values() for w in licenses.words_of(t))
    clean = licenses.scan(spark.createDataFrame([(1, far), (2, long), (3, far.replace(" ", "\n"))], "doc_id long, text string"))
    assert [(r["labels"], r["score"]) for r in clean.collect()] == [("", 0.0)] * 3


def test_matches_plain_scan(spark):
    half = " ".join(licenses.words_of(dict(licenses.TEMPLATES)["mit-grant"])[:-2])
    texts = [None, "", "...", "cc by", "CC BY CC-BY cc\nby", "xcc by", "General  Public\tLicense", "general public license " * 3 + "end",
             "ALL rights reserved. (c) cc by-nc", "Released under the MIT License.", "released under\nthe mit license", half,
             "Kelvin cc bÿ İ", "license the mit under released", "é " * 20_000 + "all rights reserved", *[
                 f"before\n{t.upper()} and more\nafter" for _, t in licenses.TEMPLATES]]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int")
    assert rows(licenses.scan(docs)) == sorted([(i, *plain(t)) for i, t in enumerate(texts)], key=str)
    twice = docs.where("doc_id in (3, 9)").selectExpr("cast(if(doc_id = 3, null, 1) as long) as doc_id", "text")
    twice = twice.unionByName(twice).unionByName(docs.where("doc_id = 8").selectExpr("1L as doc_id", "text"))
    assert rows(licenses.scan(twice)) == sorted([(None, *plain(texts[3]))] * 2 + [(1, *plain(texts[9]))] * 2 + [(1, *plain(texts[8]))], key=str)
    assert licenses.scan(docs.limit(0)).count() == 0
