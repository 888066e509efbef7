"""Substring dedup with content-defined chunks.

A gear hash rolls over the bytes of a text; where its top bits are zero the
text is cut.  Cuts depend on the last bytes only, so a passage is cut alike
wherever it stands and an insertion moves the cuts near it alone.  Chunks
are compared by a 128-bit digest over all documents; runs of neighbouring
chunks that also occur elsewhere are repeats, grown byte by byte as far as
they agree with the first occurrence; all but that one is to be removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm.common import keyed, row_key, utf8
from tessera.session import ensure_checkpoint_dir

#: Bytes that the hash looks back on, and bytes in work at a time.
REACH, BLOCK = 32, 1 << 21

#: Documents whose keys go to every task to pick their texts; with more, all texts are shuffled.
NAMED = 1_000_000


def _gear() -> np.ndarray:
    """One 32-bit word for each byte value, by the splitmix64 rule."""
    z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cut_candidates(raw: list[bytes], bits: int) -> list[np.ndarray]:
    """Ends of possible chunks in each text: where the hash of the last 32
    bytes, sum of gear[b] << distance, has ``bits`` leading zeros."""
    sizes = np.array([len(r) for r in raw])
    starts = np.cumsum(sizes + REACH) - sizes
    data = np.frombuffer(b"".join([bytes(REACH) + r for r in raw]), np.uint8)
    h = GEAR[data]
    for s in starts:
        h[s - REACH:s] = 0
    step = 1
    while step < REACH:  # each pass doubles the bytes covered
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0)
    edges = np.searchsorted(at, np.stack([starts, starts + sizes], 1))
    return [at[a:b] - s + 1 for (a, b), s in zip(edges, starts)]


def chunk_ends(n: int, candidates: list[int], least: int, most: int) -> list[int]:
    """Chunk ends of a text of n bytes: candidates at least ``least`` after
    the last cut, forced ones after ``most`` bytes without."""
    out, last = [], 0
    for end in [*candidates, n]:
        while end - last > most:
            last += most
            out.append(last)
        if end - last >= least:
            out.append(end)
            last = end
    if last < n:
        out.append(n)
    return out


def _chunked(least: int, most: int, bits: int):
    def emit(rows, ids, occs):
        raw = [r for _, r in rows]
        who, offs, sizes, digests = [], [], [], []
        for (k, data), cand in zip(rows, cut_candidates(raw, bits)):
            a = before = 0
            for b in chunk_ends(len(data), cand.tolist(), least, most):
                who.append(k)
                offs.append(a)
                sizes.append(b - a)
                # a short last chunk is alike only after an equal chunk
                seen = data[a:b] if b - a >= least else data[before:b]
                digests.append(hashlib.blake2b(seen, digest_size=16, person=b"" if b - a >= least else b"last").digest())
                a, before = b, a
        who = pa.array(who, pa.int64())
        return pa.RecordBatch.from_arrays(
            [ids.take(who), occs.take(who), pa.array(offs, pa.int64()), pa.array(sizes, pa.int32()),
             pa.array(digests, pa.binary())], ["id", "occ", "off", "len", "digest"])

    def run(batches):
        for batch in batches:
            ids, occs, texts = batch.column(0), batch.column(1), batch.column(2)
            rows, size = [], 0
            for k in range(batch.num_rows):
                data = utf8(texts[k].as_py())
                rows.append((k, data))
                size += len(data)
                if size > BLOCK:
                    yield emit(rows, ids, occs)
                    rows, size = [], 0
            if rows:
                yield emit(rows, ids, occs)
    return run


def chunk(docs: DataFrame, least: int = 32, most: int = 512, bits: int = 5) -> DataFrame:
    """Chunks (id, occ, off, len, digest) of ``docs(id, occ, text)``."""
    return docs.select("id", "occ", "text").mapInArrow(
        _chunked(least, most, bits), "id long, occ int, off long, len int, digest binary")


@F.pandas_udf(LongType())
def _alike(a: pd.Series, b: pd.Series, side: pd.Series) -> pd.Series:
    """Bytes that agree, from the start on (side 1) or from the end (-1)."""
    def one(x, y, way):
        n = min(len(x), len(y))
        x, y = (x[:n], y[:n]) if way > 0 else (x[len(x) - n:][::-1], y[len(y) - n:][::-1])
        if x == y:
            return n
        return int(np.argmax(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)))
    return pd.Series([one(x, y, w) for x, y, w in zip(a, b, side)], dtype="int64")


def _grown(texts: DataFrame, edges: DataFrame, reach: int = 512) -> DataFrame:
    """``edges(doc, off, side, kept, at, kept_at)`` with ``n``, the bytes that
    ``texts(doc, data)`` have alike beyond the places at and kept_at.  Edges
    that agree over the whole reach go on in a further round with twice of it,
    which shuffles the texts of their documents only."""
    left, done, needed = edges.withColumn("n", F.lit(0).cast("long")), None, texts
    while True:
        places = left.select("doc", "at", "side").unionByName(
            left.select(F.col("kept.doc").alias("doc"), F.col("kept_at").alias("at"), "side")).distinct() \
            .groupBy("doc").agg(F.collect_list(F.struct("at", "side")).alias("places"))

        def beside(p):
            a = F.when(p["side"] > 0, p["at"]).otherwise(F.greatest(p["at"] - reach, F.lit(0)))
            n = F.when(p["side"] > 0, F.lit(reach)).otherwise(F.least(p["at"], F.lit(reach)))
            return F.struct(p["at"].alias("at"), p["side"].alias("side"),
                            F.substring(F.col("data"), (a + 1).cast("int"), n.cast("int")).alias("bytes"))
        sides = needed.join(places, "doc").select("doc", F.inline(F.transform("places", beside)))
        # both joins take sides under its own names, so that its shuffle is made once
        tried = left.join(sides, ["doc", "at", "side"]).alias("ours").join(
            sides.alias("theirs"), F.expr("ours.kept.doc = theirs.doc and ours.kept_at = theirs.at and ours.side = theirs.side")) \
            .withColumn("more", _alike("ours.bytes", "theirs.bytes", "ours.side")) \
            .select("ours.doc", "off", "ours.side", "kept", "ours.at", "kept_at", (F.col("n") + F.col("more")).alias("n"), "more") \
            .checkpoint()
        ended = tried.where(F.col("more") < reach).select("doc", "off", "side", "kept", "n")
        done = ended if done is None else done.unionByName(ended)
        step = F.col("side") * reach
        left = tried.where(F.col("more") == reach).select(
            "doc", "off", "side", "kept", (F.col("at") + step).alias("at"), (F.col("kept_at") + step).alias("kept_at"), "n")
        named = left.select("doc").union(left.select("kept.doc")).distinct()
        n = named.count()
        if not n:
            return done
        needed = texts.join(F.broadcast(named), "doc", "left_semi") if n <= NAMED else texts
        reach *= 2


def whole_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least: int = 32, most: int = 512, bits: int = 5, run_bytes: int = 128) -> DataFrame:
    """(id, n_bytes, n_repeated, n_removed, spans) of every document.

    All chunks are compared, the short last one too (with the chunk before
    it); chunks that occur more than once, in other documents or the same,
    form runs with their neighbours.  Either end of a run is extended byte by
    byte as far as it agrees with the first occurrence, by (id, place), of its
    outer chunk, which is extended alike.  ``n_repeated`` bytes lie in runs of
    ``run_bytes`` bytes or more with their extensions, or that are the whole
    text.  ``spans`` (off, len) are the parts of such runs that are not the
    first occurrence, together ``n_removed`` bytes.  A repeat that holds no
    whole chunk is not found.  Null text: 0 bytes and no spans.  Rows that
    repeat an id are documents of their own, in the order of their texts; null
    ids come first.  An empty table gives no row.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = row_key(keyed(docs, id=id_col, text=text_col))
    plain = rows.where("id is null or occ > 0").limit(1).isEmpty()  # then the id alone names a document
    key = F.col("id").cast("long") if plain else F.struct(
        F.col("id").isNotNull().alias("named"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), "occ")
    rows = rows.withColumn("doc", key)
    pieces = chunk(rows, least, most, bits).select(key.alias("doc"), "off", "len", "digest")
    place = F.struct("doc", "off")
    again = pieces.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("kept")).where("n > 1").drop("n")
    doc = Window.partitionBy("doc").orderBy("off")
    found = pieces.join(again, "digest").select(
        "doc", "off", (F.col("off") + F.col("len")).alias("end"), "kept", (F.col("kept") == place).alias("first"))
    # neighbours that are all first or all not are one part, of which only the outer chunks grow
    new = (F.lag("end").over(doc) != F.col("off")) | (F.lag("first").over(doc) != F.col("first"))
    parts = found.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(doc)) \
        .groupBy("doc", "part").agg(
            F.min("off").alias("off"), F.max("end").alias("end"), F.max("off").alias("last"), F.max("first").alias("first"),
            F.min_by("kept", "off").alias("kept_l"), F.max_by("kept", "off").alias("kept_r")).drop("part").checkpoint()
    beside = parts.withColumn("before", F.coalesce(F.lag("end").over(doc), F.lit(0))) \
        .withColumn("after", F.lead("off").over(doc))
    sides = F.array(
        F.when((F.col("before") < F.col("off")) & (F.col("kept_l.off") > 0),
               F.struct("off", F.lit(-1).alias("side"), F.col("kept_l").alias("kept"), F.col("off").alias("at"),
                        F.col("kept_l.off").alias("kept_at"))),
        F.when(F.coalesce(F.col("after") > F.col("end"), F.lit(True)),
               F.struct(F.col("last").alias("off"), F.lit(1).alias("side"), F.col("kept_r").alias("kept"), F.col("end").alias("at"),
                        (F.col("kept_r.off") + F.col("end") - F.col("last")).alias("kept_at"))))
    edges = beside.where(~F.col("first")).select("doc", F.inline(F.filter(sides, lambda x: x.isNotNull())))
    grown = _grown(rows.select("doc", F.col("text").cast("binary").alias("data")), edges).where("n > 0")
    grown = grown.select("doc", "off", "side", "n").unionByName(grown.select("kept.doc", "kept.off", "side", "n")) \
        .groupBy("doc", "off", "side").agg(F.max("n").alias("n"))
    l_side, r_side = (grown.where(f"side = {side}").select("doc", F.col("off").alias(at), F.col("n").alias(n))
                      for side, at, n in ((-1, "off", "l"), (1, "last", "r")))
    # extensions that meet in a gap: those to be removed go first, then the left run's
    ends = beside.join(l_side, ["doc", "off"], "left").join(r_side, ["doc", "last"], "left") \
        .withColumn("l", F.least(F.coalesce("l", F.lit(0)), F.col("off") - F.col("before"))) \
        .withColumn("r", F.least(F.coalesce("r", F.lit(0)), F.coalesce(F.col("after") - F.col("end"), F.coalesce("r", F.lit(0))))) \
        .withColumn("l_room", F.col("off") - F.col("before") - F.when(~F.col("first") & F.lag("first").over(doc), 0)
                    .otherwise(F.coalesce(F.lag("r").over(doc), F.lit(0)))) \
        .withColumn("r_room", F.col("after") - F.col("end") - F.when(F.col("first") & ~F.lead("first").over(doc), F.lead("l").over(doc))
                    .otherwise(0)) \
        .select("doc", "first", (F.col("off") - F.least("l", "l_room")).alias("off"),
                (F.col("end") + F.least("r", F.coalesce("r_room", "r"))).alias("end"))
    apart = F.coalesce(F.lag("end").over(doc) != F.col("off"), F.lit(True))
    change = apart | F.coalesce(F.lag("first").over(doc) != F.col("first"), F.lit(True))
    runs = ends.withColumn("a", apart.cast("int")).withColumn("b", change.cast("int")) \
        .withColumn("run", F.sum("a").over(doc)).withColumn("part", F.sum("b").over(doc)) \
        .groupBy("doc", "run", "part") \
        .agg(F.min("off").alias("off"), F.sum(F.col("end") - F.col("off")).alias("len"), F.first("first").alias("first")) \
        .withColumn("whole", F.sum("len").over(Window.partitionBy("doc", "run"))) \
        .groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("off", "len", "first", "whole"))).alias("parts"))
    sizes = rows.select("id", "doc", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x["len"])
    none = F.array().cast("array<struct<off:bigint,len:bigint,first:boolean,whole:bigint>>")
    return sizes.join(runs, "doc", "left") \
        .withColumn("parts", F.filter(F.coalesce("parts", none), lambda x: (x["whole"] >= run_bytes) | (x["whole"] == F.col("n_bytes")))) \
        .withColumn("gone", F.filter("parts", lambda x: ~x["first"])) \
        .select(F.col("id").alias(id_col), "n_bytes", total("parts").alias("n_repeated"), total("gone").alias("n_removed"),
                F.transform("gone", lambda x: F.struct(x["off"].alias("off"), x["len"].alias("len"))).alias("spans"))
