"""Permuted copies for tree models, dealt out as cells.

A tree model sees a number only by the thresholds on either side of it, so a
row is one whole number: its cells, and its label.  A copy puts the rows in one
hash order and the values of its feature in another, as ``explain._paired``
does (the same hashes, so the same pairs), and gives the row at a place the
value at that place.  Rows travel as packed words: a part of a hash order is
sorted in one group, values go to the part of the rows whose places they have.
Equal numbers of a copy are then counted, and the model scores each once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import named
from tessera.operators.cells import code_of

#: Rows of a block, rows of a part of a hash order, rows of copies that one job deals out.
ROWS, PART, DEALT = 65_536, 400_000, 16_000_000
#: Classes that a label may have.
LABELS = 1000

_P = tuple(np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hashed(h: np.ndarray, value: int) -> np.ndarray:
    """Spark's xxhash64 of one more column, an int, after the hash ``h``."""
    h = h.astype(np.uint64) + _P[4] + np.uint64(4)
    h ^= np.uint64((value & 0xFFFFFFFF) * int(_P[0]) % 2 ** 64)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * _P[1] + _P[2]
    h ^= h >> np.uint64(33)
    h *= _P[1]
    h ^= h >> np.uint64(29)
    h *= _P[2]
    return (h ^ h >> np.uint64(32)).view(np.int64)


@dataclass(frozen=True)
class Cells:
    """Rows as whole numbers: a digit for each feature, the number of its
    ``cuts`` below the value, and one for the label, 0 if missing."""

    cuts: list[np.ndarray]
    labels: list[str]

    @property
    def bases(self) -> list[int]:
        return [*[len(c) + 1 for c in self.cuts], len(self.labels) + 1]

    @property
    def steps(self) -> list[int]:
        """The weight of each digit."""
        out = [1]
        for b in self.bases:
            out.append(out[-1] * b)
        return out

    def fits(self) -> bool:
        return self.steps[-1] < 1 << 62 and len(self.labels) <= LABELS

    def code(self, inputs: Sequence[Column], label: Column) -> Column:
        mark = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in self.labels]).cast("array<string>"), label), F.lit(0))
        digits = [*[code_of(x, c) for x, c in zip(inputs, self.cuts)], mark]
        return sum((d.cast("long") * F.lit(s) for d, s in zip(digits, self.steps)), F.lit(0).cast("long"))

    def rows(self, counted: DataFrame, features: str, label: str) -> DataFrame:
        """``counted(code)`` with a vector of its cells, and its label."""
        digits = [F.expr(f"cast((code div {s}) % {b} as int)") for s, b in zip(self.steps, self.bases)]
        values = [F.get(F.array(*[F.lit(float(v)) for v in c], F.lit(float("inf"))), d) for c, d in zip(self.cuts, digits)]
        mark = F.get(F.array(F.lit(None).cast("string"), *[F.lit(x) for x in self.labels]), digits[-1])
        return counted.withColumn(features, array_to_vector(F.array(*values))).withColumn(label, mark)


BLOCK = "key binary, code binary"


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows(key long, code long)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= ROWS:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    def block(held):
        return pd.DataFrame([{c: np.concatenate([h[c].to_numpy(np.int64) for h in held]).tobytes() for c in ("key", "code")}])

    return rows.mapInPandas(run, BLOCK)


def _groups(batches, keys: Sequence[str]) -> Iterator[tuple[tuple, list]]:
    """Rows whose ``keys`` follow one another."""
    held, key = [], None
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            now = tuple(getattr(r, k) for k in keys)
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(r)
    if held:
        yield key, held


def dealt(blocks: DataFrame, n: int, copies: dict[int, int], cells: Cells, seed: int) -> DataFrame:
    """``(copy, code, n)``: the n rows of ``blocks`` counted by their number, once
    for each of ``copies`` (number -> feature), that feature's digit dealt out anew."""
    parts = max(1, -(-n // PART))
    steps, bases, order = cells.steps, cells.bases, list(copies)

    def words(r) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(r.key, np.int64).view(np.uint64), np.frombuffer(r.code, np.int64)

    def places(key: np.ndarray, copy: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(side, hash, part) of the rows and of the values."""
        first = hashed(key, copy)
        for side, salt in enumerate((seed, seed + 7919)):
            h = hashed(first.view(np.uint64), salt)
            yield side, h, ((h >> 32) + (1 << 31)) * parts >> 32

    def sizes(batches):
        total = np.zeros((len(order), 2, parts), np.int64)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                for i, copy in enumerate(order):
                    for side, _, part in places(words(r)[0], copy):
                        total[i, side] += np.bincount(part, minlength=parts)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total.ravel()[at]})

    found = blocks.mapInPandas(sizes, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(order) * 2 * parts, np.int64)
    counts[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    starts = np.cumsum(counts.reshape(len(order), 2, parts), 2) - counts.reshape(len(order), 2, parts)
    starts = {c: starts[i] for i, c in enumerate(order)}

    def deal(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                key, code = words(r)
                out = []
                for copy, f in copies.items():
                    for side, h, part in places(key, copy):
                        by = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
                        word = code if side == 0 else code // steps[f] % bases[f]
                        both, part = np.stack([h, word], 1)[by], part[by]
                        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                        out += [{"copy": copy, "side": side, "part": int(part[lo]), "data": both[lo:hi].tobytes()}
                                for lo, hi in zip(cuts, np.append(cuts[1:], len(part)))]
                yield pd.DataFrame(out)

    def ordered(batches):
        for (copy, side, part), held in _groups(batches, ("copy", "side", "part")):
            h, word = np.concatenate([np.frombuffer(r.data, np.int64).reshape(-1, 2) for r in held]).T
            by = np.argsort(h, kind="stable")
            if (h[by[1:]] == h[by[:-1]]).any():  # rows of one id: by their numbers, however they came
                by = np.lexsort((word, h))
            word = word[by]
            if side == 0:
                yield pd.DataFrame([{"copy": copy, "part": part, "side": 0, "at": 0, "data": word.tobytes()}])
                continue
            to, at, done, out = starts[copy][0], int(starts[copy][1][part]), 0, []
            while done < len(word):  # to the parts of the rows at these places
                a = int(np.searchsorted(to, at, "right")) - 1
                end = int(to[a + 1]) if a + 1 < parts else n
                some = word[done:done + end - at]
                out.append({"copy": copy, "part": a, "side": 1, "at": at - int(to[a]), "data": some.tobytes()})
                at, done = at + len(some), done + len(some)
            yield pd.DataFrame(out)

    def paired(batches):
        for (copy, _), held in _groups(batches, ("copy", "part")):
            code = np.concatenate([np.frombuffer(r.data, np.int64) for r in held if r.side == 0])
            new = np.full(len(code), -1)
            for r in held:
                if r.side == 1:
                    word = np.frombuffer(r.data, np.int64)
                    new[r.at:r.at + len(word)] = word
            f = copies[copy]
            code = code + (new - code // steps[f] % bases[f]) * steps[f]
            code, count = np.unique(code, return_counts=True)
            yield pd.DataFrame({"copy": copy, "code": code, "n": count})

    slots = blocks.sparkSession.sparkContext.defaultParallelism
    groups = parts * len(order)
    k = min(groups, max(4 * slots, groups // 4))  # a few parts in a partition
    return blocks.mapInPandas(deal, "copy int, side int, part int, data binary") \
        .repartition(min(2 * groups, 2 * k), "copy", "side", "part").sortWithinPartitions("copy", "side", "part") \
        .mapInPandas(ordered, "copy int, part int, side int, at int, data binary") \
        .repartition(k, "copy", "part").sortWithinPartitions("copy", "part", "side") \
        .mapInPandas(paired, "copy int, code long, n long").groupBy("copy", "code").agg(F.sum("n").alias("n"))


def scores(rows: DataFrame, inputs: Sequence[str], label: str, id_col: str, cells: Cells, copies: dict[int, int], seed: int,
           scored: Callable[[DataFrame], DataFrame]) -> list[tuple[int, float]]:
    """(copy, score) of the rows as they are (copy -1) and of each of ``copies``;
    ``scored`` adds ``hit``, whether label and prediction agree, to rows of
    (copy, n, features vector, label)."""
    key = F.xxhash64(named(id_col))
    blocks = packed(rows.select(key.alias("key"), cells.code([named(c) for c in inputs], named(label).cast("string")).alias("code"))).persist()
    try:
        n = int(blocks.agg(F.coalesce(F.sum(F.octet_length("key") / 8), F.lit(0))).first()[0])
        whole = blocks.mapInPandas(_counted, "copy int, code long, n long").groupBy("copy", "code").agg(F.sum("n").alias("n"))
        at_once, numbers = max(1, DEALT // max(n, 1)), list(copies)
        jobs = [whole, *[dealt(blocks, n, {c: copies[c] for c in numbers[lo:lo + at_once]}, cells, seed) for lo in range(0, len(numbers), at_once)]]
        out = []
        for counted in jobs:
            got = scored(counted).groupBy("copy").agg(F.try_divide(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)),
                                                                  F.sum(F.when(F.col("hit").isNotNull(), F.col("n")))).alias("score"))
            out += [(r["copy"], r["score"]) for r in got.collect()]
        return out
    finally:
        blocks.unpersist()


def _counted(batches):
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            code, n = np.unique(np.frombuffer(r.code, np.int64), return_counts=True)
            yield pd.DataFrame({"copy": -1, "code": code, "n": n})
