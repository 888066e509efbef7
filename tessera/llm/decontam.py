"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; positions marked 0 are
ignored, so a substituted word there does not lose the hit.  Hashes of the
benchmark's seeds meet those of the documents; around each hit the two word
sequences are laid over one another on the hit's diagonal, and the overlap
counts if ``window`` consecutive words (or a whole shorter item) agree in at
least ``identity`` of their places.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed, utf8

#: Seeds to start from; ``complete_masks`` adds what they miss.
MASKS = ("111111", "11011011", "101101101", "1110010111")
#: Bytes of benchmark text whose seeds are broadcast at a time: a larger
#: benchmark is met block by block.
BENCHMARK_BLOCK = 32 << 20
#: Bytes of documents in work at a time, and cells compared at a time.
BLOCK, CELLS = 1 << 21, 1 << 21
HITS = "array<struct<item:int,matched:int,overlap:int,first:int>>"

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_ODD = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1 for i in range(64)], np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, start byte) of every word of lower-cased text: runs of
    digits, letters a-z and bytes beyond ASCII."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _WORD[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    size = ends - starts
    first = np.cumsum(size) - size
    letters = raw[inside[1:-1] == 1].astype(np.uint64) + np.uint64(1)
    within = np.arange(len(letters)) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), 0x5851F42D4C957F2D, np.uint64))
    h = np.add.reduceat(letters * powers[within], first)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32)), starts


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask at every place where it fits."""
    n = len(words) - len(mask) + 1
    h = np.zeros(max(0, n), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1" and n > 0:
            h += words[j:j + n] * _ODD[j % 64] ^ np.uint64(j)
    h ^= h >> np.uint64(29)
    return h


def _meets(mask: str, n: int, wrong: int) -> frozenset[int]:
    """Which of the patterns of ``wrong`` substituted places among n leave a
    hit of the mask, at one of its places or another."""
    ones = [{j + at for j, bit in enumerate(mask) if bit == "1"} for at in range(n - len(mask) + 1)]
    return frozenset(i for i, p in enumerate(combinations(range(n), wrong)) if any(not s & set(p) for s in ones))


@lru_cache(64)
def complete_masks(n: int, wrong: int) -> tuple[str, ...]:
    """Masks that meet every overlap of n words with up to ``wrong``
    substitutions, wherever these are; checked here by enumeration.  Beyond 13
    words it is the run that some n words with so few substitutions hold."""
    if n > 13:
        return ("1" * -(-(n - wrong) // (wrong + 1)),)
    chosen = [m for m in MASKS if len(m) <= n] if n == 13 else []
    left = set(range(len(list(combinations(range(n), wrong))))).difference(*(_meets(m, n, wrong) for m in chosen))
    weight = (n - wrong) // 2 + 1 if n > 1 else 1
    pool = ["1" + "".join(bits) + "1" for span in range(2, n + 1) for bits in product("01", repeat=span - 2)] + ["1"]
    met = {m: _meets(m, n, wrong) for m in pool if m.count("1") >= weight} if left else {}
    while left:
        best = max(met, key=lambda m: (len(met[m] & left), m.count("1"), m))
        chosen.append(best)
        left -= met[best]
    return tuple(chosen)


@dataclass(frozen=True)
class SeedIndex:
    """Items of one block: word hashes of each, and for each mask its sorted
    seed hashes with the item and place they come from."""

    words: list[np.ndarray]
    seeds: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    window: int
    identity: float

    @staticmethod
    def build(texts: list[str], window: int, identity: float) -> "SeedIndex":
        words = [word_hashes(utf8(t.lower()))[0] for t in texts]
        of, seeds = {}, []
        for i, w in enumerate(words):
            n = min(len(w), window)  # the words that an overlap must have
            for mask in complete_masks(n, n - int(np.ceil(identity * n - 1e-9))) if n else ():
                of.setdefault(mask, []).append(i)
        for mask, chosen in sorted(of.items()):
            h = [seed_hashes(words[i], mask) for i in chosen]
            item = np.repeat(chosen, [len(x) for x in h])
            place = np.concatenate([np.arange(len(x)) for x in h])
            h = np.concatenate(h)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[h & np.uint64((1 << 20) - 1)] = True
            seeds.append((mask, h[order], item[order], place[order], seen))
        return SeedIndex(words, seeds, window, identity)

    def hits(self, words: np.ndarray, doc: np.ndarray):
        """Unique (document, item, diagonal); doc: of every word, ascending."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, hashes, item, place, seen in self.seeds:
            h = seed_hashes(words, mask)
            at = np.flatnonzero(seen[h & np.uint64((1 << 20) - 1)])
            at = at[doc[at] == doc[at + len(mask) - 1]]
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            n = hi - lo
            at = np.repeat(at, n)
            entry = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(np.unique(np.stack([doc[at], item[entry], at - place[entry]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def verified(self, words: np.ndarray, doc: np.ndarray, first: np.ndarray) -> dict[int, dict[int, tuple]]:
        """document -> item -> (matched, overlap, first word), the overlap with
        most agreeing words; first: index of each document's first word."""
        hits, out = self.hits(words, doc), {}
        size = np.array([len(w) for w in self.words], np.int64)
        order = np.argsort(size[hits[:, 1]], kind="stable")
        hits, lo = hits[order], 0
        while lo < len(hits):
            n = int(size[hits[lo, 1]])
            hi = lo + 1
            while hi < len(hits) and size[hits[hi, 1]] == n and (hi - lo) * n < CELLS:
                hi += 1
            part, lo = hits[lo:hi], hi
            w = min(self.window, n)
            at = part[:, 2:] + np.arange(n)
            inside = (at >= first[part[:, 0]][:, None]) & (at < first[part[:, 0] + 1][:, None])
            items = np.stack([self.words[i] for i in part[:, 1]])
            same = inside & (words[np.clip(at, 0, len(words) - 1)] == items)
            total = np.zeros((len(part), n + 1), np.int32)
            np.cumsum(same, axis=1, out=total[:, 1:])
            good = total[:, w:] - total[:, :-w] >= np.ceil(self.identity * w - 1e-9)
            for r in np.flatnonzero(good.any(axis=1)).tolist():
                a, b = int(good[r].argmax()), len(good[r]) - int(good[r][::-1].argmax()) - 1 + w
                d, i, diagonal = part[r].tolist()
                got = (int(total[r, b] - total[r, a]), b - a, int(diagonal + a - first[d]))
                best = out.setdefault(d, {})
                best[i] = max(best.get(i, (-1, 0, 0)), got, key=lambda x: (x[0], -x[1], -x[2]))
        return out


def _blocks_of(texts):
    block, size = [], 0
    for i, t in enumerate(texts):
        if t:
            block.append((i, utf8(t.lower())))
            size += len(block[-1][1])
            if size > BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def _overlaps(shared):
    @F.pandas_udf(HITS)
    def find(texts: pd.Series) -> pd.Series:
        index, out = shared.value, [[] for _ in range(len(texts))]
        for block in _blocks_of(texts):
            words, starts = word_hashes(b"\n".join([b for _, b in block]))
            ends = np.cumsum([len(b) + 1 for _, b in block])
            doc = np.searchsorted(ends, starts, "right")
            first = np.searchsorted(doc, np.arange(len(block) + 1))
            for d, items in index.verified(words, doc, first).items():
                out[block[d][0]] = [{"item": i, "matched": m, "overlap": o, "first": f}
                                    for i, (m, o, f) in sorted(items.items())]
        return pd.Series(out, dtype=object)
    return find


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, window: int, identity: float):
    """(ids, broadcast index) of each block of items; items with the same
    text are one, named by the smallest id."""
    items = keyed(benchmark, id=id_col, text=text_col).where("text is not null") \
        .groupBy("text").agg(F.min("id").alias("id"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BENCHMARK_BLOCK)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("id", "text").collect()
        index = SeedIndex.build([r["text"] for r in rows], window, identity)
        yield [r["id"] for r in rows], benchmark.sparkSession.sparkContext.broadcast(index)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  window: int = 13, identity: float = 0.8) -> DataFrame:
    """(id, item, n_item_words, n_matched, n_overlap, first_word, identity) of
    every document and benchmark item that overlap.

    Of several overlaps of a pair the one with most agreeing words is given.
    Null or wordless texts overlap nothing; benchmark items with one text are
    one item, named by the smallest id; repeated documents each get their
    rows.  No overlap, or an empty table on either side, gives no row.
    """
    spark, rows, found = docs.sparkSession, keyed(docs, id=id_col, text=text_col), []
    for ids, shared in _indexes(benchmark, item_col, item_text_col, window, identity):
        names = spark.createDataFrame([(i, x, len(w)) for i, (x, w) in enumerate(zip(ids, shared.value.words))],
                                      "item int, item_id long, n_item_words int")
        hits = rows.select("id", F.explode(_overlaps(shared)("text")).alias("h")).select("id", "h.*")
        found.append(hits.join(F.broadcast(names), "item"))  # one block's items: a bounded table
    empty = spark.createDataFrame([], "item_id long, n_item_words int")
    out = reduce(DataFrame.unionByName, found) if found else \
        rows.select("id").limit(0).crossJoin(empty).selectExpr("*", "0 matched", "0 overlap", "0 first")
    return out.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "n_item_words",
                      F.col("matched").alias("n_matched"), F.col("overlap").alias("n_overlap"),
                      F.col("first").alias("first_word"), (F.col("matched") / F.col("overlap")).alias("identity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", window: int = 13, identity: float = 0.8) -> Column:
    """Boolean column: the text overlaps some benchmark item."""
    out = F.lit(False)
    for _, shared in _indexes(benchmark, item_col, item_text_col, window, identity):
        out = out | (F.size(_overlaps(shared)(F.col(f"`{text_col}`"))) > 0)
    return out
