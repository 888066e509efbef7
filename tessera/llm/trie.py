"""Prefix trie of conversations, its subtree totals by time-forward processing.

A prefix is known by its depth and the running sums, over its turns, of four
hash lanes of (depth, role, text); a node is a distinct prefix, named by its
smallest member and its depth.  The parent of a node has a smaller name: a
smaller conversation, or the same one and a smaller depth.  So ranges of names
are shards in which every path to the root leaves a shard at most once.

Totals go up by time-forward processing: a shard's nodes come in reverse level
order (sorted outside memory by Spark), each takes what its children have
sent, and sends its total to its parent through a priority queue that spills
sorted runs to disk.  What leaves a shard is sent by a shard root; shard roots
with whole subtrees inside add to the root above them, the others form a
smaller tree of shard roots, which is solved the same way, and its totals are
dealt back to the parents they hang on for a last pass inside the shards.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

#: Messages that a queue holds in memory before it writes a sorted run.
HELD = 1 << 18
#: Nodes of a shard.
SHARD = 1 << 19
#: Ids of a node's ends are joined in pieces of this range of ids.
PIECE_BITS = 16


class MessageQueue:
    """Monotone priority queue of messages to (level, name), summed by
    receiver; all but ``held`` messages lie on disk in sorted runs."""

    def __init__(self, folder: str, payloads: int, held: int = HELD):
        self.held = held
        self.folder, self.kind = folder, np.dtype([("level", "<i8"), ("name", "<i8"), ("load", "<i8", (payloads,))])
        self.fresh, self.size, self.runs, self.made = [], 0, [], 0

    def _ordered(self, parts: list[np.ndarray]) -> np.ndarray:
        """One sorted array, messages to one receiver summed."""
        all_ = np.concatenate(parts) if parts else np.empty(0, self.kind)
        if not len(all_):
            return all_
        all_ = all_[np.lexsort((all_["name"], all_["level"]))]
        new = np.append(True, (all_["level"][1:] != all_["level"][:-1]) | (all_["name"][1:] != all_["name"][:-1]))
        first = np.flatnonzero(new)
        out = all_[first].copy()
        out["load"] = np.add.reduceat(all_["load"], first, axis=0)
        return out

    def push(self, level: np.ndarray, name: np.ndarray, load: np.ndarray) -> None:
        if not len(level):
            return
        got = np.empty(len(level), self.kind)
        got["level"], got["name"], got["load"] = level, name, load
        self.fresh.append(got)
        self.size += len(got)
        if self.size > self.held:
            run = self._ordered(self.fresh)
            self.fresh, self.size = [run], len(run)
            if len(run) > self.held // 2:
                path = os.path.join(self.folder, f"run-{id(self)}-{self.made}")
                run.tofile(path)
                self.runs.append([np.memmap(path, self.kind, "r"), 0])
                self.fresh, self.size, self.made = [], 0, self.made + 1

    @staticmethod
    def _upto(a: np.ndarray, level: int, name: int, lo: int = 0) -> int:
        """Place after the last message of sorted ``a`` up to (level, name)."""
        lo, hi = lo + np.searchsorted(a["level"][lo:], [level, level + 1])
        return int(lo + np.searchsorted(a["name"][lo:hi], name, side="right"))

    def pop(self, level: int, name: int) -> np.ndarray:
        """All messages up to (level, name), sorted and summed."""
        self.fresh = [self._ordered(self.fresh)]
        cut = self._upto(self.fresh[0], level, name)
        parts = [self.fresh[0][:cut]]
        self.fresh, self.size = [self.fresh[0][cut:]], len(self.fresh[0]) - cut
        for run in self.runs:
            end = self._upto(run[0], level, name, run[1])
            parts.append(np.asarray(run[0][run[1]:end]))
            run[1] = end
        self.runs = [r for r in self.runs if r[1] < len(r[0])]
        return self._ordered(parts)


def _sent(got: np.ndarray, level: int, names: np.ndarray) -> np.ndarray:
    """For each receiver of a level its place among the messages, or -1."""
    a, b = np.searchsorted(got["level"], [level, level + 1])
    at = a + np.searchsorted(got["name"][a:b], names)
    met = at < b
    met[met] = got["name"][at[met]] == names[met]
    return np.where(met, at, -1)


def _stretches(*columns: np.ndarray):
    """(from, to) of the stretches of rows that agree in all columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    edges = np.append(np.flatnonzero(new), len(new)).tolist()
    return zip(edges, edges[1:])


def _down(held: int = HELD):
    """A shard's nodes ordered by parent: each gets the name of the shard root
    above it, sent by its parent, or its own where no parent is here."""
    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            queue, last, shard = None, None, None
            for pdf in batches:
                at, depth, conv, parent, parent_depth = (pdf[c].to_numpy() for c in ("shard", *NODE))
                root = np.stack([conv, depth], 1)
                for a, b in _stretches(at, parent_depth):
                    if at[a] != shard:
                        queue, shard, last = MessageQueue(folder, 2, held), at[a], None
                    got = queue.pop(int(parent_depth[a]), int(parent[b - 1]))
                    got = got if last is None else np.concatenate([last, got])
                    last = got[-1:] if len(got) else None  # a parent's children may go on in the next batch
                    met = _sent(got, int(parent_depth[a]), parent[a:b])
                    root[a:b][met >= 0] = got["load"][met[met >= 0]]
                    queue.push(depth[a:b], conv[a:b], root[a:b])
                yield pdf.assign(root_conv=root[:, 0], root_depth=root[:, 1])
    return run


def _up(values: list[str], roots_only: bool, held: int = HELD):
    """A shard's nodes in reverse level order: totals of all subtrees, of the
    part inside the shard, or the rows of shard roots only."""
    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            queue, shard = None, None
            for pdf in batches:
                at, depth, conv, parent, parent_depth = (pdf[c].to_numpy() for c in ("shard", *NODE))
                own = pdf[values].to_numpy(np.int64).copy()
                is_root = (pdf["root_conv"].to_numpy() == conv) & (pdf["root_depth"].to_numpy() == depth)
                for a, b in _stretches(at, depth):
                    if at[a] != shard:
                        queue, shard = MessageQueue(folder, len(values), held), at[a]
                    got = queue.pop(-int(depth[a]), int(conv[b - 1]))
                    met = _sent(got, -int(depth[a]), conv[a:b])
                    own[a:b][met >= 0] += got["load"][met[met >= 0]]
                    up = np.flatnonzero(~is_root[a:b]) + a
                    queue.push(-parent_depth[up], parent[up], own[up])
                out = pdf.assign(**{v: own[:, j] for j, v in enumerate(values)})
                yield out[is_root] if roots_only else out
    return run


#: Columns of a tree's rows: the name of a node and of its parent.
NODE = ("depth", "conv_id", "parent_conv_id", "parent_depth")


def subtree_totals(tree: DataFrame, values: list[str], shard_rows: int = SHARD, parts: int = 1, held: int = HELD) -> DataFrame:
    """(conv_id, depth, values) summed over every subtree of
    ``tree(conv_id, depth, parent_conv_id, parent_depth, values)``.

    Names (conv_id, depth) are unique, a parent's is smaller and its depth is,
    and roots have the parent_depth -1.  At least ``parts`` shards are made.
    """
    ensure_checkpoint_dir(tree.sparkSession)
    longs = ", ".join(f"{c} long" for c in ("shard", *NODE, *values))
    rooted = longs + ", root_conv long, root_depth long"
    name = ["conv_id", "depth"]
    parts = max(parts, -(-tree.count() // shard_rows))
    # checkpoint keeps the partitions, so a shard stays one partition of its table
    shards = tree.select(*NODE, *values).repartitionByRange(parts, *name) \
        .withColumn("shard", F.spark_partition_id().cast("long")).select("shard", *NODE, *values)
    labelled = shards.checkpoint().sortWithinPartitions("shard", "parent_depth", "parent_conv_id") \
        .mapInPandas(_down(held), rooted).checkpoint()
    upward = ["shard", F.desc("depth"), "conv_id"]
    roots = labelled.sortWithinPartitions(*upward).mapInPandas(_up(values, True, held), rooted).checkpoint()
    hanging = roots.where("parent_depth >= 0")
    above = labelled.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("parent_depth"),
                            F.col("root_conv").alias("up_conv"), F.col("root_depth").alias("up_depth"))
    parent = ["parent_conv_id", "parent_depth"]
    # parents that shard roots hang on, with the shard root above each
    hooks = hanging.select(*parent).distinct().join(above, parent).checkpoint()
    open_roots = hooks.select(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).distinct()
    summed = [F.sum(v).cast("long").alias(v) for v in values]
    whole = hanging.join(open_roots, name, "left_anti").groupBy(*parent).agg(*summed)
    partly = hanging.join(open_roots, name, "left_semi").select(*name, *parent).checkpoint()
    extra = whole
    if not partly.isEmpty():
        inside = whole.join(hooks, parent).groupBy("up_conv", "up_depth").agg(*[F.sum(v).alias(f"more_{v}") for v in values]) \
            .withColumnsRenamed({"up_conv": "conv_id", "up_depth": "depth"})
        smaller = roots.join(open_roots, name, "left_semi").join(inside, name, "left").join(hooks, parent, "left").select(
            *name, F.coalesce("up_conv", F.lit(0)).alias("parent_conv_id"), F.coalesce("up_depth", F.lit(-1)).alias("parent_depth"),
            *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).cast("long").alias(v) for v in values]).checkpoint()
        total = subtree_totals(smaller, values, shard_rows, 1, held)
        extra = whole.unionByName(partly.join(total, name).groupBy(*parent).agg(*summed)).groupBy(*parent).agg(*summed)
    extra = extra.select(F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth"),
                         *[F.col(v).alias(f"more_{v}") for v in values])
    full = labelled.join(extra, name, "left").select(
        "shard", *NODE, *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values], "root_conv", "root_depth")
    return full.repartition(parts, "shard").sortWithinPartitions(*upward) \
        .mapInPandas(_up(values, False, held), rooted).select(*name, *values)


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv_id, piece, place, turn_hash, words): turns numbered from 1 in a
    conversation by turn (nulls first), then role and text.

    Rows are sorted by ranges, so that a conversation of any length spreads
    over partitions; ``piece`` is its part in one of them.  A null role or text
    is an empty one; rows of a null conversation are none.
    """
    ensure_checkpoint_dir(conversations.sparkSession)
    q = lambda c: F.col(f"`{c}`")
    rows = conversations.where(q(conv_col).isNotNull()).select(
        q(conv_col).cast("long").alias("conv_id"), q(turn_col).alias("turn"),
        F.coalesce(q(role_col), F.lit("")).alias("role"), F.coalesce(q(text_col), F.lit("")).alias("text"))
    by = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(
        "conv_id", F.monotonically_increasing_id().alias("at"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("turn_hash"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).checkpoint()
    pieces = sorted_.groupBy("conv_id", F.shiftright("at", 33).alias("piece")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return sorted_.withColumn("piece", F.shiftright("at", 33)).join(pieces, ["conv_id", "piece"]).select(
        "conv_id", "piece", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "turn_hash", "words").checkpoint()


def rebuilt_turns(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) in which conversation c starts with the first h turns of
    conversation c - c % group (truncated remainder, as in SQL), h being
    crc32 of the decimal c modulo ``most``, and goes on after its own first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % group
    ids = sizes.select("conv_id", h.alias("h"), base.alias("base"))
    head = turns.where(F.col("place") < most)
    lent = ids.join(head.select(F.col("conv_id").alias("base"), "place", "turn_hash", "words"), "base").where("place <= h") \
        .select("conv_id", F.lit(-1).cast("long").alias("piece"), "place", "turn_hash", "words")
    starts = ids.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left") \
        .select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("start"))
    shift = turns.select("conv_id", "piece").distinct().join(starts, "conv_id")  # a row for each piece: no hot key
    own = turns.join(shift, ["conv_id", "piece"]).where("place > h").select(
        "conv_id", "piece", (F.col("place") - F.col("h") + F.col("start")).alias("place"), "turn_hash", "words")
    return lent.unionByName(own), ids.select("conv_id")


LANES = ["s0", "s1", "s2", "s3"]


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[c.cast("string") for c in lanes]).cast("binary")))


def _prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent_key, words) of every prefix of every
    conversation, the textless one included."""
    mark = F.md5(F.concat_ws(":", F.col("place").cast("string"), "turn_hash").cast("binary"))
    laned = turns.withColumn("mark", mark).select(
        "conv_id", "piece", "place", "words",
        *[F.conv(F.substring("mark", 8 * j + 1, 8), 16, 10).cast("long").alias(s) for j, s in enumerate(LANES)]).checkpoint()
    so_far = Window.partitionBy("conv_id", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = laned.groupBy("conv_id", "piece").agg(*[F.sum(s).alias(s) for s in LANES]).select(
        "conv_id", "piece", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"b_{s}") for s in LANES])
    summed = laned.select("*", *[F.sum(s).over(so_far).alias(f"p_{s}") for s in LANES]).join(pieces, ["conv_id", "piece"])
    upto = [F.col(f"b_{s}") + F.col(f"p_{s}") for s in LANES]
    rows = summed.select("conv_id", F.col("place").alias("depth"), _key(F.col("place"), upto).alias("key"),
                         _key(F.col("place") - 1, [u - F.col(s) for u, s in zip(upto, LANES)]).alias("parent_key"), "words")
    zero = F.lit(0).cast("long")
    top = ids.select("conv_id", zero.alias("depth"), _key(F.lit(0), [zero] * 4).alias("key"),
                     F.lit(None).cast("binary").alias("parent_key"), zero.alias("words"))
    return rows.unionByName(top).checkpoint()


def _joined_digests(batches):
    """Pieces of a node's list come one after another; only its digest is held."""
    now, key, out = None, None, []
    for pdf in batches:
        for k, text in zip(pdf["key"], pdf["ids"]):
            if now is None or k != key:
                if now is not None:
                    out.append((key, now.hexdigest()))
                now, key = hashlib.sha256(text.encode()), k
            else:
                now.update(b"," + text.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        out = []
    if now is not None:
        yield pd.DataFrame([(key, now.hexdigest())], columns=["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, ids: DataFrame, shard_rows: int = SHARD, held: int = HELD) -> DataFrame:
    """One row for each node of the trie of ``turns(conv_id, piece, place,
    turn_hash, words)`` of the conversations ``ids(conv_id)``.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): the smallest member and the depth name a node,
    the parent's smallest member its parent (root: null); n_convs members pass
    it; n_leaves childless nodes and saved_tokens, (members - 1) times the words
    of the last text, are sums over its subtree; ends_sha256 digests the
    members that end here, as decimal ids in ascending order and joined by
    commas (none: the empty text).  A conversation without turns ends at the
    root.  Equal conversations share all nodes.  No conversation: no row.
    """
    rows = _prefixes(turns, ids)
    nodes = rows.groupBy("key").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                                    F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
                                    F.min("parent_key").alias("parent_key")).checkpoint()
    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(children, "key", "left").join(parents, "parent_key", "left").select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("n_children", F.lit(0)).eqNullSafe(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")).checkpoint()
    parts = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = subtree_totals(
        tree.select("conv_id", "depth", F.coalesce("parent_conv_id", F.lit(0)).alias("parent_conv_id"),
                    (F.col("depth") - 1).alias("parent_depth"), "n_leaves", "saved_tokens"),
        ["n_leaves", "saved_tokens"], shard_rows, parts, held)
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("end"))
    piece = F.shiftright("conv_id", PIECE_BITS)
    lists = ends.groupBy(F.col("end.key").alias("key"), piece.alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids")) \
        .select("key", "piece", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    digests = lists.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids") \
        .mapInPandas(_joined_digests, "key binary, ends_sha256 string")
    return tree.drop("n_leaves", "saved_tokens").join(totals, ["conv_id", "depth"]).join(digests, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """``prefix_trie`` of a table of turns as it is."""
    turns = ordered_turns(conversations, **columns)
    return prefix_trie(turns, turns.select("conv_id").distinct())
