"""Splits, folds and feature scoring (M1, K1, Y3; M2/K2/Y4 in ``models``).

Row assignment to train/test and to folds is a pure function of the row's
id (md5 of seed and id), so it is repeatable, independent of partitioning
and of executor loss, and equal in any SQL engine that has md5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import categorical_columns, numeric_columns
from tessera.operators.clean import label_encode


def hash_bucket(id_col: str | Column, buckets: int, seed: int = 42) -> Column:
    """Integer in [0, buckets) from the first 32 bits of md5(seed || id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), c.cast("string"))), 1, 8), 16, 10)
    return (h.cast("bigint") % buckets).cast("int")


def train_test_split(df: DataFrame, id_col: str, test_pct: int = 20, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """M1: add ``split`` = 'test' for about ``test_pct``% of ids, else 'train'.
    Rows sharing an id (e.g. the lines of one order) stay together."""
    if not 0 < test_pct < 100:
        raise ValueError("test_pct must be in (0, 100)")
    return df.withColumn(out, F.when(hash_bucket(id_col, 100, seed) < test_pct, "test").otherwise("train"))


def add_folds(df: DataFrame, id_col: str, folds: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number in [0, folds) by the same id hash (for ``CrossValidator(foldCol=...)``)."""
    return df.withColumn(out, hash_bucket(id_col, folds, seed + 1))


def anova_f(df: DataFrame, label: str, cols: Sequence[str] | None = None) -> DataFrame:
    """K1: one-way ANOVA F statistic of each numeric or text column against a
    categorical label: ``(position, column, f_value)``.  Text columns enter
    as dictionary codes (NULL: -1).

    Shifted one-pass sums: a broadcast row of global means, then one
    ``groupBy(label)`` with n, Σ(x-m), Σ(x-m)² per column, then the F formula
    over the k group rows.  A text column is counted by (label, text) first and
    only these counts meet its dictionary, so no row of the table is moved.
    """
    if cols is None:
        usable = {*numeric_columns(df), *categorical_columns(df)} - {label}
        cols = [c for c in df.columns if c in usable]
    cols = list(cols)
    text = [c for c in cols if c in categorical_columns(df)]
    base = df.where(F.col(label).isNotNull())
    num = [(i, F.col(c).cast("double")) for i, c in enumerate(cols) if c not in text]
    means = base.agg(F.count(F.lit(1)).alias("__rows"), *[F.avg(x).alias(f"__m{i}") for i, x in num])
    g = base.crossJoin(F.broadcast(means)).groupBy(label).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(x - F.col(f"__m{i}")).alias(f"__s{i}") for i, x in num],
        *[F.sum(F.pow(x - F.col(f"__m{i}"), 2)).alias(f"__q{i}") for i, x in num])
    for i, c in enumerate(cols):
        if c not in text:
            continue
        counts = label_encode(base.groupBy(F.col(label).alias("__label"), F.col(c).alias("__text"))
                              .agg(F.count(F.lit(1)).cast("double").alias("__c")), ["__text"])
        mean = counts.agg((F.sum(F.col("__text") * F.col("__c")) / F.sum("__c")).alias("__m"))
        off = F.col("__text") - F.col("__m")
        sums = counts.crossJoin(F.broadcast(mean)).groupBy("__label").agg(
            F.sum(off * F.col("__c")).alias(f"__s{i}"), F.sum(F.pow(off, 2) * F.col("__c")).alias(f"__q{i}"))
        g = g.join(sums, F.col(label) == F.col("__label")).drop("__label")
    tot = g.agg(F.sum("__n").alias("N"), F.count(F.lit(1)).alias("k"),
                *[F.sum(F.pow(F.col(f"__s{i}"), 2) / F.col("__n")).alias(f"b{i}") for i in range(len(cols))],
                *[F.sum(f"__s{i}").alias(f"s{i}") for i in range(len(cols))],
                *[F.sum(f"__q{i}").alias(f"q{i}") for i in range(len(cols))])
    structs = []
    for i, c in enumerate(cols):
        ssb = F.col(f"b{i}") - F.pow(F.col(f"s{i}"), 2) / F.col("N")
        ssw = F.col(f"q{i}") - F.col(f"b{i}")
        fval = F.try_divide(F.try_divide(ssb, F.col("k") - 1), F.try_divide(ssw, F.col("N") - F.col("k")))
        structs.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), fval.alias("f_value")))
    return tot.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def select_k_best(df: DataFrame, label: str, k: int, cols: Sequence[str] | None = None) -> DataFrame:
    """K1: the k columns with the largest F: ``(rank, column, f_value)``."""
    f = anova_f(df, label, cols)
    return (f.orderBy(F.desc_nulls_last("f_value"), F.asc("position")).limit(k)
            .select(F.row_number().over(_rank_window()).alias("rank"), "column", "f_value"))


def _rank_window():
    from pyspark.sql import Window
    # the input is the k-row limit result: ordering it in one task is fine
    return Window.orderBy(F.desc_nulls_last("f_value"), F.asc("column"))


def mutual_info(df: DataFrame, label: str, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information (nats) between each equal-width-binned numeric
    column and a categorical label: ``(position, column, mi)``.

    Bins use ``floor`` (not an integer cast) clamped to bins-1.  One stacked
    ``groupBy(column, bin, label)`` gives the joint counts; the marginals are
    aggregates of that small table.
    """
    cols = list(cols)
    base = df.where(F.col(label).isNotNull())
    st = base.agg(*[F.min(F.col(c).cast("double")).alias(f"__l{i}") for i, c in enumerate(cols)],
                  *[F.max(F.col(c).cast("double")).alias(f"__h{i}") for i, c in enumerate(cols)])

    def b(i, c):
        x = F.col(c).cast("double")
        w = (F.col(f"__h{i}") - F.col(f"__l{i}")) / bins
        return F.coalesce(F.least(F.floor(F.try_divide(x - F.col(f"__l{i}"), w)), F.lit(bins - 1)),
                          F.when(x.isNotNull(), F.lit(0))).cast("int")
    j = base.crossJoin(F.broadcast(st))
    stacked = j.select(F.col(label).alias("__y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), b(i, c).alias("bin"))
        for i, c in enumerate(cols)])).alias("r")).select("__y", "r.*").where(F.col("bin").isNotNull())
    joint = stacked.groupBy("position", "column", "bin", "__y").agg(F.count(F.lit(1)).alias("nxy"))
    px = joint.groupBy("position", "bin").agg(F.sum("nxy").alias("nx"))
    py = joint.groupBy("position", "__y").agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy("position").agg(F.sum("nxy").alias("n"))
    t = joint.join(px, ["position", "bin"]).join(py, ["position", "__y"]).join(n, "position")
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
    return t.groupBy("position", "column").agg(F.sum(term).alias("mi"))
