"""Language identification by prediction by partial matching.

Per language, byte contexts of up to ``order`` bytes are counted on labelled
text and frozen.  A symbol is coded in the longest known context; an unseen
symbol pays the escape probability (method C) and is coded in the next
shorter one, symbols already offered being excluded, down to a uniform
distribution over the bytes left.  As the statistics never change while
scoring, the code length of every (context, byte, language) is worked out
once, and a text's exact code length under each language is a sum of table
entries.  The language with the shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed, packed

UNDETERMINED = "und"
#: Bytes scored at a time, which bounds a worker's memory for any text length.
BLOCK = 1 << 19


@dataclass(frozen=True)
class PpmModel:
    """``child[node, byte]``: the context one byte longer (older), or -1.
    ``bits[node, byte, language]``: code length in that context."""

    langs: list[str]
    order: int
    child: np.ndarray
    bits: np.ndarray

    def code_lengths(self, texts) -> np.ndarray:
        """Bits of every text under every language, shape (texts, languages)."""
        data, at = packed(texts)
        out = np.zeros((len(at) - 1, len(self.langs)))
        # so many bytes may be looked back at: none before a text's start
        for lo in range(0, len(data), BLOCK):
            hi = min(lo + BLOCK, len(data))
            first = int(np.searchsorted(at, lo, "right")) - 1
            last = int(np.searchsorted(at, hi, "left"))
            inner = at[first:last]
            start = np.repeat(inner, np.diff(np.append(np.maximum(inner, lo), hi)))
            pos = np.arange(lo, hi)
            node = np.zeros(hi - lo, np.int32)
            alive = np.arange(hi - lo)
            for back in range(1, self.order + 1):
                alive = alive[pos[alive] - back >= start[alive]]
                step = self.child[node[alive], data[pos[alive] - back]]
                alive = alive[step >= 0]
                node[alive] = step[step >= 0]
            cost = self.bits[node, data[lo:hi]]
            cuts = np.maximum(inner, lo) - lo
            used = np.flatnonzero(np.diff(np.append(cuts, hi - lo)) > 0)
            out[first + used] += np.add.reduceat(cost, cuts[used], axis=0, dtype=np.float64)
        return out


def _gram_counts(order: int):
    def run(batches):
        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                data, at = packed(group["text"])
                pos = np.arange(len(data))
                start = np.repeat(at[:-1], np.diff(at))
                key = np.zeros(len(data), np.int64)
                for k in range(order + 1):
                    pos = pos[pos - k >= start[pos]]
                    key[pos] |= data[pos - k].astype(np.int64) << (8 * k)
                    grams, n = np.unique(key[pos], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "k": k, "gram": grams, "n": n})
    return run


def _expected_sample(rows: DataFrame, per_lang: int) -> DataFrame:
    """About ``per_lang`` rows of each language, picked by a hash of the id."""
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    bucket = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("ppm")), F.lit(1 << 30))
    keep = F.lit(False)
    for lang, n in size.items():
        keep = keep | ((F.col("lang") == lang) & (bucket < int(min(1.0, per_lang / n) * (1 << 30))))
    return rows.where(keep)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          order: int = 4, sample_per_lang: int = 400, max_contexts: int = 3000) -> PpmModel:
    """Frozen statistics of labelled documents.

    ``sample_per_lang`` (expected number of documents of each language,
    picked by a hash of the id, whole texts) and ``max_contexts`` (the most
    frequent contexts over all languages) bound the model whatever the size
    of ``docs``.  Rows with a null text or language are not learned from; an
    empty table gives a model without languages.
    """
    rows = keyed(docs, id=id_col, text=text_col, lang=lang_col).where("text is not null and lang is not null")
    grams = _expected_sample(rows, sample_per_lang).select("lang", "text") \
        .mapInPandas(_gram_counts(order), "lang string, k int, gram long, n long") \
        .groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")) \
        .withColumn("ctx", F.shiftrightunsigned("gram", 8)).persist()
    top = grams.groupBy("k", "ctx").agg(F.sum("n").alias("total")) \
        .orderBy(F.desc("total"), "k", "ctx").limit(max_contexts)
    kept = grams.join(F.broadcast(top), ["k", "ctx"]).select("lang", "k", "ctx", "gram", "n").toPandas()
    grams.unpersist()
    return _frozen(kept, order)


def _frozen(kept: pd.DataFrame, order: int) -> PpmModel:
    langs = sorted(kept["lang"].unique())
    if not langs:
        return PpmModel([], order, np.full((1, 256), -1, np.int32), np.zeros((1, 256, 0), np.float32))
    node = {(0, 0): 0}
    parent = [-1]
    child = [np.full(256, -1, np.int32)]
    for k, ctx in sorted(set(zip(kept["k"], kept["ctx"]))):
        if k == 0:
            continue
        up = node.get((k - 1, ctx & ((1 << (8 * (k - 1))) - 1)))
        if up is None:  # a shorter context tied out of the most frequent ones
            continue
        node[(k, ctx)] = len(parent)
        child[up][ctx >> (8 * (k - 1))] = len(parent)
        parent.append(up)
        child.append(np.full(256, -1, np.int32))
    ids = np.array([node.get(x, -1) for x in zip(kept["k"], kept["ctx"])])
    count = np.zeros((len(parent), len(langs), 256), np.float32)
    ok = ids >= 0
    lang_id = kept["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    count[ids[ok], lang_id[ok], (kept["gram"].to_numpy() & 255)[ok]] = kept["n"].to_numpy()[ok]
    bits = np.empty((len(parent), 256, len(langs)), np.float32)
    chain = np.arange(len(parent))
    up = np.array(parent)
    for lo in range(0, len(parent), 512):
        at = chain[lo:lo + 512]
        p = np.zeros((len(at), len(langs), 256))
        mass = np.ones((len(at), len(langs), 1))
        free = np.ones(p.shape, bool)
        while (at >= 0).any():
            seen = np.where(free & (at >= 0)[:, None, None], count[at], 0)
            n, q = seen.sum(2, keepdims=True), (seen > 0).sum(2, keepdims=True)
            whole = n + q
            p += np.divide(mass * seen, whole, out=np.zeros_like(p), where=whole > 0)
            mass = np.where(whole > 0, mass * q / np.maximum(whole, 1), mass)
            free &= seen == 0
            at = np.where(at >= 0, up[at], -1)
        left = free.sum(2, keepdims=True)
        p += np.where(free, mass / np.maximum(left, 1), 0)
        p /= p.sum(2, keepdims=True)
        bits[lo:lo + 512] = -np.log2(p).transpose(0, 2, 1)
    return PpmModel(langs, order, np.stack(child), bits)


def predict(docs: DataFrame, model: PpmModel, text_col: str = "text") -> Column:
    """Column ``struct<lang_pred, score, bits_per_byte>`` for a text column.

    ``und`` with score 0 where the text is null, has no letter, or the model
    knows no language; ties go to the language that sorts first.  ``score``
    is the winner's posterior probability under equal priors.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        if not m.langs or not len(texts):
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0, "bits_per_byte": 0.0})
        bits = m.code_lengths(texts)
        best = bits.argmin(1)
        least = bits.min(1)
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        size = np.array([max(1, len(t.encode())) if t is not None else 1 for t in texts])
        return pd.DataFrame({"lang_pred": np.array(m.langs, object)[best], "score": score,
                             "bits_per_byte": least / size})

    text = F.col(f"`{text_col}`")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = scored(text)
    return F.when(lettered, found).otherwise(
        F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte")))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             **training) -> DataFrame:
    """Language of every document, learned from those not held out.

    A document is held out when crc32 of its id as text leaves 2 modulo 4; a
    null id is not held out.  Repeated rows each get their row.  The label of
    a document never enters its own prediction.  An empty table gives no row.
    """
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **training)
    return keyed(docs, id=id_col, text=text_col) \
        .withColumn("p", predict(docs, model)) \
        .select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "p.lang_pred", "p.score")
