"""Nearest neighbours by inner product with an adaptive dimension scan.

Vectors get one more component, so that the largest inner product is the
smallest distance, and are rotated by a random orthogonal matrix.  A k-means
on a bounded sample gives the lists; every row belongs to the list of its
nearest centre.  A query scans the lists nearest to it, column block by
column block: after the first ``d'`` rotated dimensions a hypothesis test on
the partial distance, ``partial > d'/d * (1 + eps/sqrt(d'))^2 * best``, gives a
candidate up that is most likely farther than the best so far; what is left
at the end is scored exactly on the original vectors.

Lists are cut into cells of a bounded number of rows, cells are gathered in
units, and the queries of a unit in chunks, so neither a hot list nor a
popular one gathers in one task.  The first round scans the lists nearest to
a query and gives the bound with which the second scans the others.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

#: Rows of a cell, of a unit of cells, and queries that meet a unit in one task.
CELL, UNIT, CHUNK = 2048, 8192, 8192
#: Dimensions of a column block, queries scanned together, and the test's eps.
COLUMNS, STRIP, EPS = 16, 64, 2.1
#: Most lists, rows of the sample for each list, rows of the sample from
#: which the number of lists to probe is learned.
LISTS, SAMPLE_PER_LIST, TRIALS = 1024, 24, 256


@lru_cache(4)
def _rotation(d: int) -> np.ndarray:
    """An orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(d)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _unpacked(column, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dim).astype(np.float64)


class Index:
    """Centres of the lists of vectors of one length, their sizes, and how
    many lists a query probes.  Small: at most ``LISTS`` rows."""

    def __init__(self, dim: int, kind: str, largest: float):
        self.dim, self.kind, self.largest = dim, kind, largest
        self.centres = np.zeros((1, dim + 1))
        self.sizes = np.zeros(1, np.int64)
        self.probes = 1

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Rotated vectors of norm 1: scaled by the largest norm, and filled up."""
        x = x / self.largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
        return np.concatenate([x, rest[:, None]], 1) @ _rotation(self.dim + 1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Rotated directions: a distance is 2 - 2 * inner product / (norm * largest)."""
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        return np.concatenate([x, np.zeros((len(x), 1))], 1) @ _rotation(self.dim + 1)

    def distances(self, y: np.ndarray) -> np.ndarray:
        return (self.centres ** 2).sum(1) - 2 * (y @ self.centres.T)

    def lists_of(self, y: np.ndarray) -> np.ndarray:
        return self.distances(y).argmin(1)

    def fit(self, sample: np.ndarray, n_lists: int, k: int, recall: float) -> None:
        """k-means on the sample; then the number of probes with which
        ``recall`` of the ``k`` nearest in the sample are met."""
        y = self.candidates(sample)
        rng = np.random.Generator(np.random.PCG64(1))
        self.centres = y[np.sort(rng.permutation(len(y))[:n_lists])].copy()
        for _ in range(8):
            near = self.lists_of(y)
            n = np.bincount(near, minlength=len(self.centres))
            sums = np.stack([np.bincount(near, y[:, j], len(self.centres)) for j in range(y.shape[1])], 1)
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centres)
        near = self.lists_of(y)
        trial = np.sort(rng.permutation(len(y))[:TRIALS])
        q = self.queries(sample[trial])
        score = q @ y.T
        score[np.arange(len(trial)), trial] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :min(k, len(y) - 1)]
        order = np.argsort(self.distances(q), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        need = np.sort(np.take_along_axis(place, near[best], 1).ravel())
        self.probes = 1 + int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) if len(need) else 1

    def layout(self) -> None:
        """Cells of each list, numbered through, and the unit of each cell."""
        self.cells = np.maximum(1, -(-self.sizes // CELL))
        self.first = np.cumsum(self.cells) - self.cells
        rows = np.repeat(-(-self.sizes // self.cells), self.cells)
        self.unit = (np.cumsum(rows) - rows) // UNIT

    def probed(self, y: np.ndarray, k: int, near: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Each query's lists, nearest first: ``probes``, more where these hold
        no more than k rows; and how many of them hold ``near`` rows together,
        those of the first round."""
        order = np.argsort(self.distances(y), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], 1)
        many = np.maximum(self.probes, 1 + (held[:, :-1] <= k).sum(1))
        return [o[:m] for o, m in zip(order, many)], np.minimum(1 + (held[:, :-1] < near).sum(1), many)


def _listed(index: Index):
    def run(batches):
        for pdf in batches:
            vec = [np.asarray(v, index.kind).tobytes() for v in pdf["vec"]]
            y = index.candidates(_unpacked(vec, index.kind, index.dim))
            yield pdf.assign(vec=vec, list=index.lists_of(y))
    return run


def _asked(index: Index, k: int, near: int):
    """How many queries of a batch probe each list."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                lists, _ = index.probed(index.queries(_unpacked(pdf["vec"], index.kind, index.dim)), k, near)
                n = np.bincount(np.concatenate(lists), minlength=len(index.sizes))
                yield pd.DataFrame({"list": np.flatnonzero(n), "n": n[n > 0]})
    return run


def _per_list(counts: DataFrame, index: Index) -> np.ndarray:
    """n of each list; at most ``LISTS`` rows come to the driver."""
    out = np.zeros(len(index.centres), np.int64)
    for l, n in counts.collect():
        out[l] = n
    return out


def _placed(index: Index, k: int, near: int, chunks: np.ndarray):
    """Rows of candidates and queries with the unit, the chunk and the lists
    that they meet there; ``round`` 1 or 2."""
    def run(batches):
        for pdf in batches:
            out = []
            cell = index.first[pdf["list"]] + pdf["rid"].to_numpy() % index.cells[pdf["list"]]
            unit = index.unit[cell]
            for row, u, l in zip(range(len(pdf)), unit.tolist(), pdf["list"].tolist()):
                out += [(0, u, c, row, [l]) for c in range(chunks[u])]
            asks = np.flatnonzero(pdf["asks"].to_numpy())
            if len(asks):
                y = index.queries(_unpacked(pdf["vec"].iloc[asks], index.kind, index.dim))
                for row, lists, first in zip(asks.tolist(), *index.probed(y, k, near)):
                    for turn, some in ((1, lists[:first]), (2, lists[first:])):
                        met = {}
                        for l in some.tolist():
                            for u in np.unique(index.unit[index.first[l]:index.first[l] + index.cells[l]]).tolist():
                                met.setdefault(u, []).append(l)
                        rid = int(pdf["rid"].iat[row])
                        out += [(turn, u, rid // 7 % int(chunks[u]), row, ls) for u, ls in met.items()]
            rows = [o[3] for o in out]
            yield pd.DataFrame({"round": [o[0] for o in out], "unit": [o[1] for o in out], "chunk": [o[2] for o in out],
                                "lists": [o[4] for o in out], **{c: pdf[c].to_numpy()[rows] for c in ("rid", "vec_id", "named", "vec")}})
    return run


class _Unit:
    """The candidates of a unit, in column blocks by list."""

    def __init__(self, index: Index, pdf: pd.DataFrame):
        self.index = index
        self.rid, self.vec_id, self.named = (pdf[c].to_numpy() for c in ("rid", "vec_id", "named"))
        self.x = _unpacked(pdf["vec"], index.kind, index.dim)
        y = index.candidates(self.x)
        self.blocks = [np.ascontiguousarray(y[:, j:j + COLUMNS].T) for j in range(0, y.shape[1], COLUMNS)]
        self.square = (self.blocks[0] ** 2).sum(0)
        of = np.array([l[0] for l in pdf["lists"]], np.int64)
        self.rows = {l: np.flatnonzero(of == l) for l in np.unique(of).tolist()}

    def scan(self, x, rid, lists, bound, k):
        """(query, candidate, score) of those that the tests leave, at most
        about k of a query.  ``bound``: least score wanted of each query."""
        index, y = self.index, self.index.queries(x)
        norm = np.sqrt(((x / np.abs(x).max(1, keepdims=True)) ** 2).sum(1)) * np.abs(x).max(1)
        bound, best, d = bound.copy(), [([], []) for _ in x], y.shape[1]
        asking = {}
        for q, ls in enumerate(lists):
            for l in ls:
                asking.setdefault(l, []).append(q)
        for l in sorted(asking):
            rows = self.rows.get(l)
            if rows is None:
                continue
            for at in range(0, len(asking[l]), STRIP):
                qs = np.array(asking[l][at:at + STRIP])
                # distances beyond this are given up; the margin covers rounding
                worst = np.maximum(0.0, 2 - 2 * (bound[qs] / norm[qs] / index.largest)) + 1e-9
                for j, block in enumerate(self.blocks):
                    z, seen = y[qs, j * COLUMNS:(j + 1) * COLUMNS], min(d, (j + 1) * COLUMNS)
                    share = seen / d * (1 + EPS / np.sqrt(seen)) ** 2 if seen < d else 1 + 1e-9
                    if j == 0:
                        part = (z * z).sum(1)[:, None] + self.square[rows] - 2 * (z @ block[:, rows])
                        a, b = np.nonzero(part <= share * worst[:, None])
                        part = part[a, b]
                    else:
                        part = part + ((z[a].T - block[:, rows[b]]) ** 2).sum(0)
                        live = np.flatnonzero(part <= share * worst[a])
                        a, b, part = a[live], b[live], part[live]
                keep = self.rid[rows[b]] != rid[qs[a]]
                a, b = a[keep], b[keep]
                score = np.concatenate([np.empty(0)] + [(self.x[rows[b[i:i + 4096]]] * x[qs[a[i:i + 4096]]]).sum(1)
                                                        for i in range(0, len(a), 4096)])
                for i, q in enumerate(qs.tolist()):
                    lo, hi = np.searchsorted(a, [i, i + 1])
                    if hi == lo:
                        continue
                    got, val = np.append(best[q][0], rows[b[lo:hi]]).astype(np.int64), np.append(best[q][1], score[lo:hi])
                    if len(got) > k:
                        order = np.lexsort((self.vec_id[got], ~self.named[got], -val))[:k]
                        got, val = got[order], val[order]
                        bound[q] = max(bound[q], val[-1])
                    best[q] = got, val
        for q, (got, val) in enumerate(best):
            if len(got):
                yield q, np.asarray(got, np.int64), np.asarray(val)


def _scanned(index: Index, k: int):
    """Units come one after another, their candidates before their queries;
    candidates are held, queries stream through."""
    def run(batches):
        held, key, unit = [], None, None
        for pdf in batches:
            edge = (pdf["unit"] != pdf["unit"].shift()) | (pdf["chunk"] != pdf["chunk"].shift())
            for _, some in pdf.groupby(edge.cumsum()):
                now = some["unit"].iat[0], some["chunk"].iat[0]
                if now != key:
                    held, key, unit = [], now, None
                cand, asks = some[some["round"] == 0], some[some["round"] > 0]
                if len(cand):
                    held.append(cand)
                if not len(asks) or not held:
                    continue
                unit = unit or _Unit(index, pd.concat(held))
                out = []
                x, rid = _unpacked(asks["vec"], index.kind, index.dim), asks["rid"].to_numpy()
                for q, got, val in unit.scan(x, rid, asks["lists"].tolist(), asks["bound"].to_numpy(np.float64), k):
                    out.append(pd.DataFrame({"rid": rid[q], "query_id": asks["vec_id"].iat[q], "vec_id": unit.vec_id[got],
                                             "named": unit.named[got], "score": val}))
                if out:
                    yield pd.concat(out)
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ranked from 1."""
    order = Window.partitionBy("rid").orderBy(F.desc("score"), F.desc("named"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_length(rows: DataFrame, dim: int, kind: str, k: int, recall: float, lists: int | None) -> DataFrame:
    spark = rows.sparkSession
    packed = rows.where(F.size("vec") == dim)
    top = F.array_max(F.transform("vec", lambda v: F.abs(v).cast("double")))
    norm = top * F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + F.pow(v / top, F.lit(2.0))))
    n, n_asks, largest = packed.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.max(norm)).first()
    if not n_asks:
        return None
    n_lists = lists or int(min(LISTS, max(1, round(n ** 0.5))))
    # the rows of least hash: the same sample at any layout of the table
    sample = packed.orderBy(F.xxhash64("vec", "rid"), "rid").limit(n_lists * SAMPLE_PER_LIST).select("vec").toPandas()
    index = Index(dim, kind, largest)
    index.fit(np.array(sample["vec"].tolist(), kind).astype(np.float64), n_lists, k, recall)
    row = "rid long, vec_id long, named boolean, asks boolean, vec binary"
    listed = packed.mapInPandas(_listed(index), row + ", list int").checkpoint()
    index.sizes = _per_list(listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")), index)
    index.layout()
    # units that many queries meet have them dealt to several chunks, each with the unit's rows
    near = 10 * k
    asked = _per_list(listed.where("asks").mapInPandas(_asked(index, k, near), "list int, n long")
                      .groupBy("list").agg(F.sum("n").alias("n")), index)
    load = np.bincount(index.unit, np.repeat(asked, index.cells))
    chunks = np.maximum(1, np.ceil(load / CHUNK)).astype(np.int64)
    placed = listed.mapInPandas(_placed(index, k, near, chunks), "round int, unit long, chunk long, lists array<int>, "
                                "rid long, vec_id long, named boolean, vec binary").checkpoint()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "rid long, query_id long, vec_id long, named boolean, score double"

    def scanned(asks):
        met = placed.where("round = 0").withColumn("bound", F.lit(None).cast("double")).unionByName(asks)
        return met.repartition(parts, "unit", "chunk").sortWithinPartitions("unit", "chunk", "round", "rid") \
            .mapInPandas(_scanned(index, k), schema)

    first = _best(scanned(placed.where("round = 1").withColumn("bound", F.lit(-np.inf))), k).checkpoint()
    bound = first.groupBy("rid").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(-np.inf).alias("bound"))
    second = scanned(placed.where("round = 2").join(bound, "rid", "left").select(
        *placed.columns, F.coalesce("bound", F.lit(-np.inf)).alias("bound")))
    return _best(first.drop("rank").unionByName(second), k)


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20,
           recall: float = 0.97, lists: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found nearest to every
    row whose id is divisible by ``every``.

    Nearest is the largest inner product in double precision; equal scores
    come by smaller id, null ids last.  A row is no candidate of itself;
    other rows are, even if equal.  Queries that repeat an id are queries of
    their own.  Vectors that are null, empty, zero or hold a null or
    non-finite component take no part, a null id asks nothing, and vectors
    meet those of their own length only.  ``recall`` is aimed at on the
    sample, 24 rows for each of at most 1,024 lists; every row is indexed.
    An empty table gives no row.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = raw.where(F.coalesce(~bad & F.exists("vec", lambda x: x != 0), F.lit(False))).select(
        F.monotonically_increasing_id().alias("rid"), F.coalesce("vec_id", F.lit(0)).alias("vec_id"),
        F.col("vec_id").isNotNull().alias("named"), "vec", F.coalesce(F.col("vec_id") % every == 0, F.lit(False)).alias("asks")).checkpoint()
    kind = "<f4" if dict(rows.dtypes)["vec"] == "array<float>" else "<f8"
    out = None
    for (dim,) in sorted(rows.where("asks").select(F.size("vec")).distinct().collect()):  # one index for each length
        part = _of_length(rows, dim, kind, k, recall, lists)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out.select("query_id", "rank", F.when(F.col("named"), F.col("vec_id")).alias("vec_id"), "score")
