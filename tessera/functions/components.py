"""Connected components of an edge table by alternating stars.

Each round is two aggregations and two joins on the edge table; hubs are
met by map-side minima and by skew-split joins.  Lineage is cut after every
round with ``checkpoint()`` into the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    up = both.where(F.col("b") > F.col("a"))
    return up.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.withColumnRenamed("m", "b")).distinct()


def _state(e: DataFrame):
    return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` with long ids, any direction, repeats and loops allowed.

    Returns ``(node, root)`` for every node with an edge to another node;
    root is the smallest node of its component, and roots themselves have no
    row.  Rounds run until the edge table no longer changes, without a limit.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct().checkpoint()
    before = _state(e)
    while before[0]:
        e = _small_star(_large_star(e)).checkpoint()
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
