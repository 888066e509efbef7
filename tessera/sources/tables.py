"""Parquet tables of a scale-factor folder, plus derived inputs.

The derived inputs are plain projections over the driver tables (no row is
dropped or sampled): they plant holes, text and labels the raw tables lack,
so that missing-value, conversion and metric operators have something to
find.  Each one is defined identically in ``ORACLE_CTES`` as SQL so the
DuckDB oracle sees the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str, spread_small: bool | None = None) -> DataFrame:
    """Read one table.  A table stored as a single Parquet row group scans
    as a single task; when the scan has fewer splits than task slots it is
    spread once by round-robin when ``tessera.spreadSmallScans`` is true
    (default off: for one-pass aggregates the extra shuffle costs more than
    the parallelism gains; CPU-heavy kernels spread their own input).
    At cluster scale the scan has far more splits than slots and nothing
    moves."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread_small is None:
        spread_small = spark.conf.get("tessera.spreadSmallScans", "false") == "true"
    return spread(df) if spread_small else df


def _hole(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def orders_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        _hole(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        _hole(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


def lineitem_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.withColumn("charge", F.col("l_extendedprice") * (1 - F.col("l_discount"))) \
             .withColumn("is_returned", F.col("l_returnflag") == "R")


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    txt = (F.when(k == 0, "abc").when(k == 1, " 7 ").when(k == 2, "1,000")
           .when(k == 3, "").otherwise("12"))
    return o.select("o_orderkey", txt.alias("txt"))


def customer_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.withColumn("c_mktsegment",
                        _hole(F.col("c_custkey") % 11 == 0, F.col("c_mktsegment")))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    score = F.col("l_discount") * 10
    return li.select("l_orderkey", "l_linenumber",
                     (F.col("l_returnflag") == "R").alias("y"),
                     score.alias("score"),
                     (score >= 0.5).alias("pred"))


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    flip = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10 == 0
    base = F.col("l_quantity") > 25
    label = F.when(flip, ~base).otherwise(base).cast("int")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                     label.alias("label"))


def reg_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    noise = (F.col("l_orderkey") % 17 - 8).cast("double")
    y = 3 * F.col("l_quantity") + 0.001 * F.col("l_extendedprice") + noise
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", y.alias("y"))


def documents_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to their quality/toxicity labels (inner join)."""
    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels")
    return d.join(lab, "doc_id")


# SQL text of the same derived inputs, for the DuckDB oracle.
ORACLE_CTES = {
    "orders_missing": """orders_missing AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)""",
    "lineitem_corr": """lineitem_corr AS (
  SELECT *, l_extendedprice * (1 - l_discount) AS charge,
         (l_returnflag = 'R') AS is_returned
  FROM lineitem)""",
    "orders_text": """orders_text AS (
  SELECT o_orderkey,
         CASE o_orderkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN ' 7 ' WHEN 2 THEN '1,000'
                             WHEN 3 THEN '' ELSE '12' END AS txt
  FROM orders)""",
    "customer_nulls": """customer_nulls AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)""",
    "scored_lines": """scored_lines AS (
  SELECT l_orderkey, l_linenumber, (l_returnflag = 'R') AS y,
         l_discount * 10 AS score, (l_discount * 10 >= 0.5) AS pred
  FROM lineitem)""",
    "model_rows": """model_rows AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus,
         CAST(CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 = 0
                   THEN NOT (l_quantity > 25) ELSE (l_quantity > 25) END AS INTEGER) AS label
  FROM lineitem)""",
}


def with_ctes(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the WITH clauses of the named derived inputs."""
    if not names:
        return sql
    return "WITH " + ",\n".join(ORACLE_CTES[n] for n in names) + "\n" + sql
