"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; the hash is the nearest of the 2d signed axes.  ``hashes`` such
values make a table's key, ``tables`` tables are used, and besides its own
bucket a vector probes the next likely ones of each table.  Pairs that meet
in a bucket are verified by cosine in double precision.  A pair that meets in
several buckets counts in the first of them only, which either side's keys
tell, so links are counted inside the blocks and pairs are never emitted.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.components import connected_components
from tessera.session import ensure_checkpoint_dir

#: Rows of a block, rows compared with a block at a time, and rows of a block
#: up to which blocks are compared together.
LANES, STRIP, SMALL = 4096, 256, 32
#: Axes of each rotation that probes choose from.
NEAREST = 4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotated(x: np.ndarray, rotation: int) -> np.ndarray:
    """Three rounds of signs and Hadamard transform, zero-padded to a power
    of two; additions in one fixed order, so every task gets the same values."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, :x.shape[1]] = x
    rng = np.random.Generator(np.random.PCG64([rotation, d]))
    for _ in range(3):
        y = y * (2.0 * rng.integers(0, 2, d) - 1)
        half = 1
        while half < d:
            z = y.reshape(len(x), -1, 2, half)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(x), d)
            half *= 2
        y = y / np.sqrt(d)
    return y


def bucket_keys(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Keys (rows, tables, probes): the own bucket first, then those that lose
    least squared distance to the hashed axes."""
    out = np.empty((len(x), tables, probes), np.int64)
    for t in range(tables):
        axes, losses = [], []
        for k in range(hashes):
            y = rotated(x, t * hashes + k)
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :NEAREST]
            top = np.take_along_axis(y, order, 1)
            axes.append(2 * order + (top < 0))
            losses.append((np.abs(top[:, :1]) - np.abs(top)) ** 2)
        d2 = 2 * y.shape[1]
        choices = np.array(list(product(range(axes[0].shape[1]), repeat=hashes)))
        loss = sum(losses[k][:, choices[:, k]] for k in range(hashes))
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        key = np.zeros(best.shape, np.int64)
        for k in range(hashes):
            key = key * d2 + np.take_along_axis(axes[k], choices[best, k], 1)
        out[:, t] = key
    return out


def _hashed(tables: int, hashes: int, probes: int, kind: str):
    """Adds a vector's bytes and its bucket keys."""
    def run(batches):
        for pdf in batches:
            for _, same in pdf.groupby(pdf["vec"].map(len)):
                x = np.array(same["vec"].tolist(), kind)
                keys = bucket_keys(unit(x), tables, hashes, probes)
                yield pd.DataFrame({"id": same["id"], "label": same["label"], "dim": x.shape[1], "n": same["n"],
                                    "vec": [v.tobytes() for v in x], "keys": list(keys.reshape(len(x), -1))})
    return run


def _pairs(block: np.ndarray, x: np.ndarray, threshold: float):
    """(a, b) of rows of the same block with a cosine of at least threshold:
    small blocks all together, shift by shift, large ones by strips."""
    edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    size = np.diff(np.append(edges, len(block)))
    small = np.repeat(size <= SMALL, size)
    for shift in range(1, int(size[size <= SMALL].max(initial=0))):
        a = np.flatnonzero((block[:-shift] == block[shift:]) & small[shift:])
        for part in np.array_split(a, 1 + len(a) // 20_000):
            near = (x[part] * x[part + shift]).sum(1) >= threshold
            yield part[near], part[near] + shift
    for first, n in zip(edges[size > SMALL], size[size > SMALL]):
        y = x[first:first + n]
        for lo in range(0, n, STRIP):
            a, b = np.nonzero(y[lo:lo + STRIP] @ y[lo:].T >= threshold)
            keep = a < b
            yield first + lo + a[keep], first + lo + b[keep]


def _linked(rows: pd.DataFrame, threshold: float, tables: int, probes: int, kind: str):
    """(id, links, root) of the rows, whole blocks of one length of vector,
    that have a link; root is the first row that they reach in their block."""
    t, key = rows["t"].to_numpy(), rows["k"].to_numpy()
    x = unit(np.frombuffer(b"".join(rows["vec"]), kind).reshape(len(rows), -1))
    keys = np.stack(rows["keys"].to_numpy()).reshape(len(rows), tables, probes)
    own, weight = keys[:, :, 0], rows["n"].to_numpy()
    home = own[np.arange(len(rows)), t] == key
    lo, hi, c = (rows[name].to_numpy() for name in ("lo", "hi", "c"))
    links, found = np.zeros(len(rows), np.int64), []
    for a, b in _pairs(rows["block"].to_numpy(), x, threshold):
        ok = (home[a] | home[b]) & ((lo[a] == hi[a]) | (c[a] != c[b]))
        a, b = a[ok], b[ok]
        for some in np.array_split(np.arange(len(a)), 1 + len(a) // 20_000):
            i, j = a[some], b[some]
            # the first table and there the smallest bucket in which the two meet
            ij, ji = ((own[p][:, :, None] == keys[q]).any(2) for p, q in ((i, j), (j, i)))
            first = (ij | ji).argmax(1)
            at = np.arange(len(i))
            far = np.iinfo(np.int64).max
            least = np.minimum(np.where(ij[at, first], own[i, first], far), np.where(ji[at, first], own[j, first], far))
            mine = (first == t[i]) & (least == key[i])
            i, j = i[mine], j[mine]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            found.append((i, j))
    root = np.arange(len(rows))
    a, b = (np.concatenate(p) for p in zip(*found)) if found else (root[:0], root[:0])
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        for end in (a, b):
            np.minimum.at(root, root[end], low)
            np.minimum.at(root, end, low)
        root = root[root]
    ids, some = rows["id"].to_numpy(), links > 0
    return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[root[some]]})


def _blocks(*args):
    group = ["label", "dim", "t", "k", "lo", "hi"]

    def run(batches):
        held = []

        def done(parts):
            pdf = pd.concat(parts)
            pdf["block"] = (pdf[group] != pdf[group].shift()).any(axis=1).cumsum()
            for _, same in pdf.groupby("dim"):
                yield _linked(same, *args)

        for pdf in batches:  # blocks come one after another and may span batches
            if not len(pdf):
                continue
            last = (pdf[group] == pdf[group].iloc[-1]).all(axis=1)
            if last.all():
                held.append(pdf)
                continue
            yield from done([*held, pdf[~last]])
            held = [pdf[last]]
        if held:
            yield from done(held)
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, tables: int = 6, hashes: int = 2, probes: int = 4) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Vectors with equal, non-null labels and equal length link at a cosine of
    at least ``threshold``.  A vector that is null, empty, zero or holds a
    null or non-finite component links with nothing, nor does one with a null
    label.  ``n_links`` counts the other rows linked directly, equal vectors
    included; ``component_id`` is the smallest id reachable (the own one
    without links); ``kept``: the id is that smallest one.  Rows that repeat
    an id each count; a row with a null id links like any other, and its
    component is null unless it reaches an id.  An empty table gives no row.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec"),
                          F.col(f"`{label_col}`").cast("string").alias("label"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(~bad & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    # a class is known by a number of its own: ids may repeat on other vectors
    classes = rows.where(usable).groupBy("label", "vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")) \
        .select(F.monotonically_increasing_id().alias("id"), "first", "label", "vec", "n").checkpoint()
    kind = "<f4" if dict(rows.dtypes)["vec"] == "array<float>" else "<f8"
    hashed = classes.drop("first").mapInPandas(_hashed(tables, hashes, probes, kind), "id long, label string, dim int, n long, "
                                 "vec binary, keys array<long>").checkpoint()
    entry = hashed.select("id", "label", "dim", F.posexplode("keys").alias("p", "k")) \
        .select("id", "label", "dim", F.floor(F.col("p") / probes).cast("int").alias("t"), "k", (F.col("p") % probes == 0).alias("home"))
    sizes = entry.groupBy("label", "dim", "t", "k") \
        .agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("homes")).where("rows > 1 and homes")
    meets = entry.join(sizes, ["label", "dim", "t", "k"]).groupBy("id") \
        .agg(F.collect_list(F.struct("t", "k", F.ceil(F.col("rows") / (LANES // 2)).alias("parts"))).alias("meets"))
    blocks = hashed.join(meets, "id").withColumn("m", F.explode("meets")) \
        .withColumn("c", F.pmod(F.xxhash64("id", F.lit(1)), F.col("m.parts"))) \
        .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m.parts") - 1))) \
        .select("label", "dim", "m.t", "m.k", "c", "id", "n", "vec", "keys",
                F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi")) \
        .repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label", "dim", "t", "k", "lo", "hi") \
        .sortWithinPartitions("label", "dim", "t", "k", "lo", "hi", "c", "id")
    found = blocks.mapInPandas(_blocks(threshold, tables, probes, kind), "id long, links long, root long").checkpoint()
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    members = classes.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left") \
        .withColumn("root", F.coalesce("root", "id"))
    smallest = members.where("links is not null").groupBy("root").agg(F.min("first").alias("component"))
    named = members.join(smallest, "root", "left") \
        .select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"),
                (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component"))
    out = rows.withColumn("usable", usable).join(
        named, F.col("usable") & (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
