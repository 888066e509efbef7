"""Near-duplicates by SimHash fingerprints, compared bit-sliced.

Fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of
``blocks`` slices of their bits, so equal slices bring every linked pair
into a common bucket.  In a bucket the fingerprints stand as vertical bit
planes: a query is compared with all others at once, one plane after the
other, saturating carry-save counters hold the distances, and the rest of
the planes is skipped as soon as every lane is beyond the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed
from tessera.functions.components import connected_components
from tessera.session import ensure_checkpoint_dir

SEED = 42
BITS = 64
#: Shingles whose hashes are held at a time, and rows compared at a time.
BLOCK, LANES = 1 << 16, 4096


def fingerprint_of(text: str | None, width: int) -> int:
    """Signed 64-bit fingerprint of a text; null or without words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n, ones = len(words) - width + 1, np.zeros(BITS, np.int64)
    hashed = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        a, b = starts[lo:min(n, lo + BLOCK)].tolist(), ends[lo + width - 1:min(n, lo + BLOCK) + width - 1].tolist()
        h = np.array([hashed(joined[i:j], SEED) for i, j in zip(a, b)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """Fingerprint of the word shingles of a text column: A-Z lower-cased,
    words between ASCII white space, XXH64 of each shingle (seed 42), a bit
    set if it is in over half of the hashes."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, width) for t in texts], dtype="int64")

    return of(text)


def bit_planes(values: list[int]) -> list[int]:
    """Plane b holds bit b of every value, value k in bit k of the plane."""
    raw = np.array(values, "<i8").view(np.uint8).reshape(-1, 8)
    rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [int.from_bytes(r.tobytes(), "little") for r in rows]


def within(planes: list[int], value: int, live: int, radius: int) -> int:
    """Lanes of ``live`` whose value differs from ``value`` in at most
    ``radius`` bits.  Counters start so that radius + 1 differences overflow."""
    width = (radius + 1).bit_length()
    begin = (1 << width) - 1 - radius
    counters = [live if begin >> k & 1 else 0 for k in range(width)]
    for b, plane in enumerate(planes):
        carry = (live & ~plane) if value >> b & 1 else (live & plane)
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        if carry:
            live &= ~carry
            if not live:
                return 0
    return live


class _Forest:
    """Which lanes of a block are known to be connected, as lane masks."""

    def __init__(self, n: int):
        self.top, self.mask = list(range(n)), [1 << k for k in range(n)]

    def find(self, k: int) -> int:
        while self.top[k] != k:
            self.top[k] = self.top[self.top[k]]
            k = self.top[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.top[b] = a
        self.mask[a] |= self.mask[b]


def _links(values: list[int], side: list[int], ids: list[int], radius: int):
    """Links that connect what lies within the radius in one block: every
    connected pair of lanes is connected by them, none beyond the radius."""
    planes, forest = bit_planes(values), _Forest(len(values))
    other = [sum(1 << k for k, s in enumerate(side) if s != mine) for mine in (0, 1)] if any(side) else None
    for k, value in enumerate(values):
        if other is None:
            live = (1 << k) - 1
        elif side[k]:
            live = other[1]
        else:
            continue
        live &= ~forest.mask[forest.find(k)]
        hits = within(planes, value, live, radius) if live else 0
        while hits:
            low = (hits & -hits).bit_length() - 1
            yield ids[k], ids[low]
            forest.join(k, low)
            hits &= ~forest.mask[forest.find(k)]


def _blocks(radius: int):
    def run(batches):
        held: list[pd.DataFrame] = []

        def links(pdf):
            out = []
            for _, block in pdf.groupby(["t", "k", "lo", "hi"], sort=False):
                if len(block) > 1:
                    side = ((block["c"] == block["hi"]) & (block["lo"] != block["hi"])).astype(int).tolist()
                    out += _links(block["fp"].tolist(), side, block["id"].tolist(), radius)
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        for pdf in batches:  # blocks come whole and one after another, but may span batches
            last = pdf[["t", "k", "lo", "hi"]].eq(pdf[["t", "k", "lo", "hi"]].iloc[-1]).all(axis=1) if len(pdf) else None
            if last is None:
                continue
            if last.all():
                held.append(pdf)
                continue
            yield links(pd.concat([*held, pdf[~last]]))
            held = [pdf[last]]
        if held:
            yield links(pd.concat(held))
    return run


def slice_keys(fp: Column, blocks: int, radius: int) -> Column:
    """array<struct<t, k>>: one bucket for each choice of blocks - radius slices."""
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    slices = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(bounds, bounds[1:])]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(0).cast("long")
        for i in chosen:
            key = F.shiftleft(key, bounds[i + 1] - bounds[i]).bitwiseOR(slices[i])
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("k")))
    return F.array(*keys)


def links(classes: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``classes(id, fp)`` that
    connect exactly what distances of at most ``radius`` connect.

    A bucket beyond LANES rows is cut into parts, and every pair of parts is
    a block of its own, so no task holds a whole hot bucket.
    """
    rows = classes.select("id", "fp", F.explode(slice_keys(F.col("fp"), blocks, radius)).alias("b")) \
        .select("id", "fp", "b.t", "b.k")
    shared = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / (LANES // 2))
    rows = rows.join(shared, ["t", "k"]).withColumn("parts", parts) \
        .withColumn("c", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts"))) \
        .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("id", "fp", "t", "k", "c", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"))
    parts_out = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number is not coalesced to one task
    return rows.repartition(parts_out, "t", "k", "lo", "hi").sortWithinPartitions("t", "k", "lo", "hi", "c", "fp") \
        .mapInPandas(_blocks(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(id, fingerprint, component_id) of every document.

    component_id is the smallest id reachable over links of at most ``radius``
    differing bits.  Texts without words (null, empty) have fingerprint zero
    and link like any other.  Repeated rows each get their row.  A row with a
    null id takes part in no link and gets the smallest id of the documents
    with its fingerprint's component, null if there is none.  An empty table
    gives no row.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = keyed(docs, id=id_col, text=text_col).select("id", fingerprint(F.col("text"), width).alias("fp")).checkpoint()
    classes = rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("id"))
    roots = connected_components(links(classes, radius, blocks))
    found = classes.join(roots, classes["id"] == roots["node"], "left") \
        .select(F.col("fp").alias("class_fp"), F.coalesce("root", "id").alias("component_id"))
    return rows.join(found, F.col("fp") == F.col("class_fp"), "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
