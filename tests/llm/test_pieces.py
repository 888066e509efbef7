"""Piece encoding against a plain Viterbi, decoding against the public library."""
import random

import numpy as np
import pytest
import sentencepiece

from conftest import SF_SMALL
from tessera.llm import pieces


@pytest.fixture(scope="module")
def vocab():
    return pieces.load_vocabulary()


@pytest.fixture(scope="module")
def library():
    """The public library on the same file, for decoding."""
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def brute(v, text):
    """Viterbi over the whole text with a plain dictionary of pieces."""
    if not text:
        return []
    data = (" " + text).encode()
    by = {v.pieces[int(p)]: (float(s), int(p)) for p, s in zip(v.piece, v.score) if p >= 0}
    longest = max(map(len, by))
    best = [(-1e300, 0, [])] * (len(data) + 1)
    best[0] = (0.0, 0, [])
    for i in range(len(data)):
        if best[i][0] == -1e300:
            continue
        first = data[i]
        size = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        edges = [(j, *by[data[i:j]]) for j in range(i + 1, min(len(data), i + longest) + 1) if data[i:j] in by]
        cuts = [(j, s, [p]) for j, s, p in edges]
        if not any(j == i + size for j, _, _ in edges):
            cuts.append((i + size, v.unknown_score, [int(v.byte_id[b]) for b in data[i:i + size]]))
        for j, s, ids in cuts:
            if best[i][0] + s > best[j][0]:
                best[j] = (best[i][0] + s, i, ids)
    out, at = [], len(data)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return [x for ids in out[::-1] for x in ids]


TEXTS = ["Hello world", "  two  spaces ", "naïve café 北京 🙂", "a\nb\tc", "x" * 300, "Thhaer eronti the. Lyre", "£€\u0000z", " "]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_brute_force(vocab, library, text):
    ids = pieces.Encoder(vocab)(text).tolist()
    assert ids == brute(vocab, text)
    assert pieces.decode_ids(vocab, ids) == library.decode(ids) == text


def test_documents(spark, vocab, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = pieces.encode_documents(docs).collect()
    assert len(out) == len(texts) and all(r["round_trip"] for r in out)
    for r in out[:12]:
        assert r["ids"] == brute(vocab, texts[r["doc_id"]])
        assert r["n_tokens"] == len(r["ids"]) and library.decode(r["ids"]) == texts[r["doc_id"]]


def test_together_is_one_by_one(vocab):
    rng = random.Random(5)
    words = ["".join(rng.choices("aeéß北 thTH.\n🙂", k=rng.randint(1, 60))).encode() for _ in range(400)]
    together = [np.frombuffer(ids, np.int32).tolist() for ids in pieces.encode_words(vocab, words)]
    assert together == [pieces.encode_one(vocab, w) for w in words]


def test_trie_holds_the_pieces(vocab):
    found = {int(p) for p in vocab.piece if p >= 0}
    assert len(found) > 31_000 and vocab.by_word
    for i in random.Random(2).sample(sorted(found), 500):
        s = 0
        for b in vocab.pieces[i]:
            t = int(vocab.base[s]) + b
            assert vocab.check[t] == s
            s = t
        assert vocab.piece[s] == i


def test_without_word_rule_and_byte_pieces():
    v = pieces.vocabulary(["<unk>", "a", "b▁", "b", "▁a"], [0, -1, -1.25, -2, -.5], [2, 1, 1, 1, 1])
    assert not v.by_word
    assert pieces.Encoder(v)("ab aβ").tolist() == [4, 2, 1, 0]


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "mark ▁ x"), (5, "word " * 60_000)]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, ids long")
    columns = docs.withColumn("ids", pieces.encode(docs))
    assert [r["back"] for r in columns.withColumn("back", pieces.decode(columns)).collect()] == \
        [None, "", "a", "a", "mark   x", "word " * 60_000]
    out = sorted(pieces.encode_documents(docs).collect(), key=lambda r: (r["doc_id"] or 0, r["n_tokens"]))
    assert [(r["doc_id"], r["round_trip"]) for r in out] == [(None, False), (1, None), (2, True), (3, True), (3, True), (5, True)]
    assert out[1]["ids"] is None and out[2]["ids"] == [] and out[5]["n_tokens"] >= 60_000
    assert pieces.encode_documents(docs.limit(0)).count() == 0
