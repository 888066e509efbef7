"""Periodic runs of words by multi-scale minimizers.

A run is a maximal stretch of words in which words ``q`` apart are equal, at
least two periods long.  Periods below ``SHORT`` are found by scanning every
lag directly.  A scale finds the periods from ``p`` to ``2p``: each window of
k-grams, ``k = p/2``, picks its least hash; inside a run the windows one
period apart hold the same words and pick the same place, so some pair of
equal minimizers stands exactly one period apart and seeds an extension word
by word.  K-grams that lie in a run of a period of at most ``k/2`` would pair
without end and are left out; the only runs whose windows hold nothing else
lie across two touching runs of one shorter period, and are seeded from such
junctions.  So every run is found, in time near linear in the words.

Texts are worked through in blocks: their words are numbered together, and a
symbol of its own ends each text, so that no run crosses it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed, utf8

#: Periods below this are found by direct lag scans; a power of two.
SHORT = 16
#: Words of texts in work together, unless a text alone is longer.
BLOCK = 1 << 15
#: Runs count from this many words on.
LEAST = 12

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def _stretches(x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal stretches of period ``lag`` of two periods or more."""
    at = np.flatnonzero(x[:-lag] == x[lag:])
    if len(at) < lag:
        return at[:0], at[:0]
    new = np.flatnonzero(np.append(True, np.diff(at) > 1))
    start, last = at[new], at[np.append(new[1:], len(at)) - 1]
    long = last - start + 1 >= lag
    return start[long], last[long] + lag + 1


def _extended(x: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """(start, end) of the stretch of period ``lag`` around place i, where x[i] == x[i + lag]."""
    end, step = i, 64
    while True:
        a, b = x[end:end + step], x[end + lag:end + lag + step]
        same = a[:len(b)] == b
        if len(same) == step and same.all():
            end, step = end + step, 2 * step
            continue
        end += len(same) if same.all() else int(same.argmin())
        break
    start, step = i, 64
    while start:
        step = min(step, start)
        same = (x[start - step:start] == x[start + lag - step:start + lag])[::-1]
        if same.all():
            start, step = start - step, 2 * step
            continue
        start -= int(same.argmin())
        break
    return start, end + lag


def _window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, by doubling."""
    low, size = v, 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    return np.minimum(low[:len(v) - width + 1], low[width - size:]) if size < width else low


def _minimizer_seeds(h: np.ndarray, k: int, left_out: np.ndarray | None):
    """(place, lag) of equal minimizers ``2k`` to ``4k`` words apart."""
    bits = np.uint64(len(h).bit_length())
    none = np.uint64((1 << 64) - 1)
    v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    if left_out is not None:
        v[left_out] = none
    low = _window_minima(v, k // 2 + 1)
    low = low[np.append(True, low[1:] != low[:-1])] if len(low) else low
    at = (low[low != none] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    at = np.unique(at)
    key = h[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    places, lags = [], []
    for step in itertools.count(1):
        near = (key[:-step] == key[step:]) & (at[step:] - at[:-step] < 4 * k)
        if not near.any():
            break
        near &= at[step:] - at[:-step] >= 2 * k
        places.append(at[:-step][near])
        lags.append(at[step:][near] - places[-1])
    empty = at[:0]
    return (np.concatenate(places), np.concatenate(lags)) if places else (empty, empty)


def _junction_seeds(x: np.ndarray, runs: np.ndarray, p: int):
    """(place, lag) of runs of a period from p to 2p that lie across two
    touching runs of one period up to p/4."""
    runs = runs[(runs[:, 2] <= p // 4) & (runs[:, 1] - runs[:, 0] >= p)]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    touch = np.flatnonzero((runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 0] <= runs[:-1, 1]))
    for (a0, a1, d), (b0, b1, _) in zip(runs[touch].tolist(), runs[touch + 1].tolist()):
        root = x[b0:b0 + d]
        for turn in np.flatnonzero(x[a0:a0 + d] == root[0]).tolist():
            if (x[a0 + turn:a0 + turn + d] == root).all():
                least = b0 - a0 - turn
                for lag in range(least + -((least - p) // d) * d, 2 * p, d):
                    first = max(a0, b0 - lag)
                    if lag >= p and min(a1, b1 - lag) - first >= lag:
                        yield first, lag
                break


def find_runs(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All runs (start, end, period) of two periods or more of the symbols
    ``x``, sorted by start and period.  ``ends`` are the places of the symbols
    that end a text, which occur nowhere else; texts come longest first."""
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, min(SHORT, len(x))):
        for start, end in zip(*(a.tolist() for a in _stretches(x, lag))):
            found.setdefault((start, end), lag)  # the smallest period comes first
    sizes = np.diff(np.append(-1, ends)) - 1
    p, k = SHORT, 1
    h = _mixed((x.astype(np.uint64) + np.uint64(1)) * _MIX[0])
    while len(sizes) and 2 * p <= sizes[0]:
        n = int(ends[np.searchsorted(-sizes, -2 * p, side="right") - 1]) + 1  # longer texts only
        x, h = x[:n], h[:n - k + 1]
        while 2 * k < p:
            h, k = _mixed(h[:-k] * _MIX[0] + (h[k:] ^ (h[k:] >> np.uint64(32)))), 2 * k
        runs = np.array([(s, e, q) for (s, e), q in found.items()], np.int64).reshape(-1, 3)
        inner = runs[(runs[:, 2] <= k // 2) & (runs[:, 1] - runs[:, 0] >= k) & (runs[:, 0] < len(h))]
        left_out = None
        if len(inner):
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, inner[:, 0], 1)
            np.add.at(edge, np.minimum(inner[:, 1] - k + 1, len(h)), -1)
            left_out = np.cumsum(edge[:-1]) > 0
        at, lags = _minimizer_seeds(h, k, left_out)
        order = np.lexsort((at, lags))
        reached, last = -1, 0
        across = _junction_seeds(x, runs[runs[:, 1] <= n], p)
        for i, lag in itertools.chain(zip(at[order].tolist(), lags[order].tolist()), across):
            if lag == last and i < reached:
                continue  # in the stretch that the seed before has given
            if x[i] != x[i + lag]:
                continue
            start, end = _extended(x, i, lag)
            reached, last = end - lag, lag
            if end - start >= 2 * lag:
                found.setdefault((start, end), lag)  # a smaller period is known from before
        p *= 2
    out = np.array([(s, e, q) for (s, e), q in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _runs_of(texts: list[list[bytes]], least: int):
    """For each text its runs (start, length, period) of ``least`` words or more."""
    order = sorted(range(len(texts)), key=lambda t: -len(texts[t]))
    seen, count = {}, itertools.count()
    total = sum(map(len, texts)) + len(texts)
    x, ends, at = np.empty(total, np.int64), np.empty(len(texts), np.int64), 0
    for place, t in enumerate(order):
        n = len(texts[t])
        x[at:at + n] = np.fromiter(map(seen.setdefault, texts[t], count), np.int64, n)
        ends[place] = at + n
        at += n + 1
    x[ends] = -1 - np.arange(len(ends))
    runs = find_runs(x, ends)
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    whose = np.searchsorted(ends, runs[:, 0])
    first = np.append(-1, ends)[whose] + 1
    out = [[] for _ in texts]
    for place, start, end, base, q in zip(whose.tolist(), *(c.tolist() for c in (runs[:, 0], runs[:, 1], first, runs[:, 2]))):
        out[order[place]].append((start - base, end - start, q))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat inside a run."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return b" ".join(itertools.compress(words, kept.tolist()))


def _found(least: int):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def emit(ids, texts):
        runs = _runs_of(texts, least)
        shown = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        kept = [_collapsed(t, r).decode("utf-8", "surrogatepass") for t, r in zip(texts, runs)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(shown, spans),
             pa.array(kept, pa.string())], ["id", "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                texts.append(utf8(text.as_py()).split())
                size += len(texts[-1])
                if size >= BLOCK:
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield emit(ids, texts)
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed) of every document.

    Words are what ASCII blanks (space, \\t to \\r) part.  ``runs`` (start,
    length, period) are all maximal stretches of words with smallest period
    ``period`` of at least ``least`` words and two periods, by start, then
    period; ``collapsed`` is the text without words that a run holds after its
    first period, joined by one space.  A null or empty text has no words, no
    runs and collapses to the empty text.  Null ids and rows that repeat an id
    are documents of their own; an empty table gives no row.
    """
    rows = keyed(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text")
    schema = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(_found(least), schema).withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``periodic_runs`` with, per document, the number of runs, the longest
    one (ties: smallest start, then period; nulls without runs) and digests of
    the list of runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                              r["period"].cast("string"), F.lit("\n"))
    length = -F.col("best.length")
    return found.withColumn("best", longest).select(
        F.col(f"`{id_col}`"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        length.alias("length"), F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's texts: in documents whose crc32 of the decimal id ends
    in 0, the words from place a on repeat those of one period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    # the words of a text are taken once, by binding them to the lambda
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    there = text.rlike(r"[^\x20\x09-\x0D]")
    return F.when((F.pmod(h, F.lit(10)) == 0) & there, F.transform(F.array(words), changed)[0]).otherwise(text)
