"""Registered workloads: one Spark callable and (where SQL can express it)
one DuckDB oracle statement per operator of the inventory.

Every callable reads the Parquet tables of ``sf_dir`` (or inputs Spark
derives from them over all rows) and returns a lazy DataFrame.  Doubles
are rounded to 6 decimals on both sides only where the value goes to the
SQL comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.columns import round_doubles as r6
from tessera.functions.columns import spread
from tessera.operators import profile as G
from tessera.sources import tables as S
from tessera.sources.tables import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _profile_sql(table: str, cols: list[tuple[str, str]], ctes: tuple[str, ...] = ()) -> str:
    parts = []
    for i, (c, t) in enumerate(cols):
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS missing, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS \"unique\" FROM {table}")
    return with_ctes("\nUNION ALL\n".join(parts), *ctes)


ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")]


@register("column_profile", _profile_sql("orders", ORDERS_COLS))
def q_column_profile(spark, sf):
    return r6(G.column_profile(S.load(spark, sf, "orders")))


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _dbl(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


# --------------------------------------------------------------------------
# Profiles (G1-G5, G11, G12, G20-G22)
# --------------------------------------------------------------------------
from tessera.operators import select as P  # noqa: E402
from tessera.operators import clean as C  # noqa: E402
from tessera.operators import charts as H  # noqa: E402

OM_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("unique_counts", _union([
    f"SELECT {i} AS position, '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS \"unique\" FROM orders"
    for i, (c, _) in enumerate(ORDERS_COLS)]))
def q_unique_counts(spark, sf):
    return G.unique_counts(S.load(spark, sf, "orders"))


@register("missing_counts", with_ctes(_union([
    f"SELECT {i} AS position, '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing FROM orders_missing"
    for i, c in enumerate(OM_COLS)]), "orders_missing"))
def q_missing_counts(spark, sf):
    return G.missing_counts(S.orders_missing(spark, sf))


@register("missing_pct", with_ctes(_union([
    f"SELECT {i} AS position, '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing, "
    f"{_dbl(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct FROM orders_missing"
    for i, c in enumerate(OM_COLS)]), "orders_missing"))
def q_missing_pct(spark, sf):
    return r6(G.missing_pct(S.orders_missing(spark, sf)))


@register("drop_missing_rows", with_ctes(
    "SELECT * FROM orders_missing WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL",
    "orders_missing"))
def q_drop_missing_rows(spark, sf):
    return P.drop_missing_rows(S.orders_missing(spark, sf))


@register("drop_missing_columns", with_ctes(
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders_missing", "orders_missing"))
def q_drop_missing_columns(spark, sf):
    return P.drop_missing_columns(S.orders_missing(spark, sf))


EV_NUM = ["event_id", "user_id", "value"]


@register("column_stats", _union([
    f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS count, {_dbl(f'avg({c})')} AS mean, "
    f"{_dbl(f'stddev_samp({c})')} AS std, {_dbl(f'min({c})')} AS min, {_dbl(f'max({c})')} AS max FROM events"
    for i, c in enumerate(EV_NUM)]))
def q_column_stats(spark, sf):
    return r6(G.column_stats(S.load(spark, sf, "events"), EV_NUM))


_EV_STATS = ("WITH s AS (SELECT " + ", ".join(
    f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(EV_NUM)) + " FROM events)\n")


@register("outlier_counts", _EV_STATS + _union([
    f"SELECT {i} AS position, '{c}' AS \"column\", CAST(count_if(abs(({c} - m{i}) / s{i}) > 3) AS BIGINT) AS outliers "
    f"FROM events, s" for i, c in enumerate(EV_NUM)]))
def q_outlier_counts(spark, sf):
    return G.outlier_counts(S.load(spark, sf, "events"), 3.0, EV_NUM)


_VAL_STATS = "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)\n"


@register("outlier_rows", _VAL_STATS + "SELECT e.* FROM events e, s WHERE abs((e.value - s.m) / s.sd) > 3")
def q_outlier_rows(spark, sf):
    return P.outlier_rows(S.load(spark, sf, "events"), "value")


@register("outlier_summary", _VAL_STATS +
          "SELECT 'value' AS \"column\", count(*) AS outliers FROM events e, s WHERE abs((e.value - s.m) / s.sd) > 3")
def q_outlier_summary(spark, sf):
    return P.outlier_summary(S.load(spark, sf, "events"), "value")


@register("remove_outliers", _VAL_STATS + "SELECT e.* FROM events e, s WHERE abs((e.value - s.m) / s.sd) <= 3")
def q_remove_outliers(spark, sf):
    return P.remove_outliers(S.load(spark, sf, "events"), "value")


@register("cap_outliers", _VAL_STATS +
          "SELECT event_id, ts, user_id, event_type, "
          "round(least(greatest(value, m - 3 * sd), m + 3 * sd), 6) AS value, props FROM events, s")
def q_cap_outliers(spark, sf):
    return r6(P.cap_outliers(S.load(spark, sf, "events"), "value"))


_MODE_SQL = """SELECT '{c}' AS "column", {c} AS mode, count(*) AS count FROM {t}
WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1"""


@register("mode_value", with_ctes(_MODE_SQL.format(c="o_orderpriority", t="orders_missing"), "orders_missing"))
def q_mode_value(spark, sf):
    return G.mode_value(S.orders_missing(spark, sf), "o_orderpriority")


@register("impute_mode", with_ctes("""
, md AS (SELECT o_orderpriority AS v FROM orders_missing WHERE o_orderpriority IS NOT NULL
         GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderdate,
       coalesce(o_orderpriority, md.v) AS o_orderpriority FROM orders_missing, md""", "orders_missing")
          .replace("\n\n,", ",", 1).replace(")\n\n, md", "),\nmd", 1))
def q_impute_mode(spark, sf):
    return r6(C.impute_mode(S.orders_missing(spark, sf)))


@register("impute_mean", with_ctes("""SELECT o_orderkey, o_custkey, o_orderstatus,
  round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_missing)), 6) AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders_missing""", "orders_missing"))
def q_impute_mean(spark, sf):
    return r6(C.impute_mean(S.orders_missing(spark, sf)))


@register("impute_median", with_ctes("""SELECT o_orderkey, o_custkey, o_orderstatus,
  round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_missing)), 6) AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders_missing""", "orders_missing"))
def q_impute_median(spark, sf):
    return r6(C.impute_median(S.orders_missing(spark, sf)))


# --------------------------------------------------------------------------
# Bar / pie
# --------------------------------------------------------------------------

@register("group_agg_mean", "SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity FROM lineitem "
          "WHERE l_returnflag IS NOT NULL GROUP BY 1")
def q_group_agg_mean(spark, sf):
    return r6(G.group_agg(S.load(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "mean"))


@register("group_agg_sum", "SELECT l_returnflag, round(coalesce(sum(l_quantity), 0), 6) AS l_quantity FROM lineitem "
          "WHERE l_returnflag IS NOT NULL GROUP BY 1")
def q_group_agg_sum(spark, sf):
    return r6(G.group_agg(S.load(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "sum"))


@register("group_agg_count", "SELECT l_returnflag, count(l_quantity) AS l_quantity FROM lineitem "
          "WHERE l_returnflag IS NOT NULL GROUP BY 1")
def q_group_agg_count(spark, sf):
    return G.group_agg(S.load(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "count")


@register("group_agg_none", "SELECT l_returnflag, l_quantity FROM lineitem WHERE l_returnflag IS NOT NULL")
def q_group_agg_none(spark, sf):
    return G.group_agg(S.load(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "none")


@register("value_counts", """SELECT c_mktsegment, count(*) AS count,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def q_value_counts(spark, sf):
    return r6(G.value_counts(S.load(spark, sf, "customer"), "c_mktsegment"))


# --------------------------------------------------------------------------
# Correlation and advice
# --------------------------------------------------------------------------
LC_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "charge", "is_returned"]


def _d(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


@register("correlation_matrix", with_ctes(_union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({_d(a)}, {_d(b)}), 6) AS corr FROM lineitem_corr"
    for a in LC_COLS for b in LC_COLS]), "lineitem_corr"))
def q_correlation_matrix(spark, sf):
    return r6(G.correlation_matrix(S.lineitem_corr(spark, sf)))


@register("high_corr_pairs", with_ctes("SELECT * FROM (" + _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({_d(a)}, {_d(b)}), 6) AS corr, "
    f"abs(corr({_d(a)}, {_d(b)})) >= 1.0 AS exact FROM lineitem_corr"
    for i, a in enumerate(LC_COLS) for b in LC_COLS[i + 1:]]) + ") t WHERE abs(corr) > 0.8", "lineitem_corr"))
def q_high_corr_pairs(spark, sf):
    return r6(G.high_corr_pairs(S.lineitem_corr(spark, sf)))


LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("low_cardinality", _union([
    f"SELECT {i} AS position, '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS \"unique\", "
    f"count(DISTINCT {c}) < 5 AS low_cardinality FROM lineitem" for i, c in enumerate(LI_COLS)]))
def q_low_cardinality(spark, sf):
    return G.low_cardinality(S.load(spark, sf, "lineitem"))


@register("detect_task", """
SELECT 'l_returnflag' AS target, CAST(least(count(DISTINCT l_returnflag), 10) AS BIGINT) AS distinct_seen,
       'classification' AS task FROM lineitem
UNION ALL
SELECT 'l_quantity', CAST(least(count(DISTINCT l_quantity), 10) AS BIGINT),
       CASE WHEN count(DISTINCT l_quantity) < 10 THEN 'classification' ELSE 'regression' END FROM lineitem""")
def q_detect_task(spark, sf):
    li = S.load(spark, sf, "lineitem")
    return G.detect_task(li, "l_returnflag").unionByName(G.detect_task(li, "l_quantity"))


@register("class_counts", "SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY 1")
def q_class_counts(spark, sf):
    return G.class_counts(S.load(spark, sf, "lineitem"), "l_returnflag")


_OM_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
_REC_BODY = f"""
SELECT 'missing' AS rule, '{G.ADVICE_MISSING}' AS detail
WHERE (SELECT {' + '.join(f'count(*) - count({c})' for c in OM_COLS)} FROM orders_missing) > 0
UNION ALL
SELECT 'correlated', '{G.ADVICE_CORRELATED}'
WHERE (SELECT {' OR '.join(f'abs(corr({_d(a)}, {_d(b)})) > 0.8' for i, a in enumerate(_OM_NUM) for b in _OM_NUM[i + 1:])}
       FROM orders_missing)
UNION ALL
SELECT 'one_hot', '{G.ADVICE_ONE_HOT}'
WHERE (SELECT {' OR '.join(f'count(DISTINCT {c}) < 5' for c in OM_COLS)} FROM orders_missing)
UNION ALL
SELECT 'model_type', '{G.ADVICE_CLASSIFICATION}'"""
_REC_SQL = with_ctes(_REC_BODY, "orders_missing")


@register("recommendations", _REC_SQL)
def q_recommendations(spark, sf):
    return G.recommendations(S.orders_missing(spark, sf), target="o_orderstatus")


# --------------------------------------------------------------------------
# Projection, conversion, filters
# --------------------------------------------------------------------------

@register("to_numeric", with_ctes("SELECT o_orderkey, TRY_CAST(txt AS DOUBLE) AS txt FROM orders_text", "orders_text"))
def q_to_numeric(spark, sf):
    return P.to_numeric(S.orders_text(spark, sf), "txt")


@register("to_categorical", with_ctes(
    "SELECT o_orderkey, txt, CAST(dense_rank() OVER (ORDER BY txt) - 1 AS INTEGER) AS txt_code FROM orders_text",
    "orders_text"))
def q_to_categorical(spark, sf):
    return C.to_categorical(S.orders_text(spark, sf), "txt")


@register("to_string", with_ctes(
    "SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, "
    "coalesce(c_mktsegment, 'nan') AS c_mktsegment FROM customer_nulls", "customer_nulls"))
def q_to_string(spark, sf):
    d = P.to_string(S.customer_nulls(spark, sf), "c_nationkey")
    return r6(P.to_string(d, "c_mktsegment", null_text="nan"))


@register("filter_exact_edges", "SELECT p_partkey, p_partkey + 9007199254740000 AS big, p_size FROM part WHERE p_partkey = 93 "
          "UNION ALL SELECT p_partkey, p_partkey + 9007199254740000, p_size FROM part WHERE p_size = 7")
def q_filter_exact_edges(spark, sf):
    """Integers beyond 2^53 match themselves only; decimals, ``nan``, text and
    numbers out of range match no integer; ``7.0`` matches 7."""
    from pyspark.sql import functions as F
    p = S.load(spark, sf, "part").select("p_partkey", (F.col("p_partkey") + 9007199254740000).alias("big"), "p_size")
    out = P.filter_exact(p, "big", "9007199254740093").unionByName(P.filter_exact(p, "p_size", " 7.0 "))
    for text in ("7.5", "nan", "inf", "seven", "99999999999999999999"):
        out = out.unionByName(P.filter_exact(p, "p_size", text))
    return out


@register("to_numeric_nan", with_ctes("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN TRY_CAST(txt AS DOUBLE) END AS txt "
          "FROM orders_text", "orders_text"))
def q_to_numeric_nan(spark, sf):
    from pyspark.sql import functions as F
    t = S.orders_text(spark, sf)
    return P.to_numeric(t.withColumn("txt", F.when(F.col("o_orderkey") % 3 == 0, "NaN").otherwise(F.col("txt"))), "txt")


@register("filter_exact", "SELECT * FROM part WHERE p_size = 7 UNION ALL SELECT * FROM part WHERE p_brand = 'Brand#13'")
def q_filter_exact(spark, sf):
    p = S.load(spark, sf, "part")
    return P.filter_exact(p, "p_size", "7").unionByName(P.filter_exact(p, "p_brand", "Brand#13"))


@register("filter_range", "SELECT * FROM part WHERE p_retailprice BETWEEN 920 AND 950")
def q_filter_range(spark, sf):
    return P.filter_range(S.load(spark, sf, "part"), "p_retailprice", 920, 950)


@register("filter_in", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_filter_in(spark, sf):
    return P.filter_in(S.load(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@register("distinct_values", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL")
def q_distinct_values(spark, sf):
    return P.distinct_values(S.load(spark, sf, "orders"), "o_orderpriority")


@register("select_features", "SELECT c_name, c_nationkey, c_acctbal, c_custkey FROM customer")
def q_select_features(spark, sf):
    return P.select_features(S.load(spark, sf, "customer"))


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def q_preview(spark, sf):
    return P.preview(S.load(spark, sf, "orders"), 5, "o_orderkey")


@register("shape", "SELECT count(*) AS rows, 11 AS cols FROM lineitem")
def q_shape(spark, sf):
    return P.shape(S.load(spark, sf, "lineitem"))


# --------------------------------------------------------------------------
# Encoding and scaling (C7-C11) and the wizard
# --------------------------------------------------------------------------

@register("label_encode", with_ctes(
    "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, "
    "CAST(CASE WHEN c_mktsegment IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY c_mktsegment IS NULL "
    "ORDER BY c_mktsegment) - 1 END AS INTEGER) AS c_mktsegment FROM customer_nulls", "customer_nulls"))
def q_label_encode(spark, sf):
    return r6(C.label_encode(S.customer_nulls(spark, sf), ["c_mktsegment"]))


@register("one_hot", "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderdate, "
          "o_orderpriority, coalesce(o_orderstatus = 'F', false) AS o_orderstatus_F, "
          "coalesce(o_orderstatus = 'O', false) AS o_orderstatus_O, "
          "coalesce(o_orderstatus = 'P', false) AS o_orderstatus_P FROM orders")
def q_one_hot(spark, sf):
    return r6(C.one_hot(S.load(spark, sf, "orders"), ["o_orderstatus"]))


_CUST = "SELECT c_custkey, c_name, c_nationkey, {expr} AS c_acctbal, c_mktsegment FROM customer"


@register("log_transform", _CUST.format(expr="round(ln(1 + greatest(c_acctbal, 0.0)), 6)"))
def q_log_transform(spark, sf):
    return r6(C.log_transform(S.load(spark, sf, "customer"), "c_acctbal"))


@register("standard_scale", "WITH s AS (SELECT avg(c_acctbal) m, stddev_samp(c_acctbal) sd FROM customer)\n" +
          _CUST.format(expr="round((c_acctbal - m) / sd, 6)") + ", s")
def q_standard_scale(spark, sf):
    return r6(C.standard_scale(S.load(spark, sf, "customer"), "c_acctbal"))


@register("minmax_scale", "WITH s AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer)\n" +
          _CUST.format(expr="round((c_acctbal - lo) / (hi - lo), 6)") + ", s")
def q_minmax_scale(spark, sf):
    return r6(C.minmax_scale(S.load(spark, sf, "customer"), "c_acctbal"))


# --------------------------------------------------------------------------
# Chart data
# --------------------------------------------------------------------------
_FENCE = "value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
_QUART = ("q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, "
          "quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL GROUP BY 1)")


@register("box_stats", f"""WITH {_QUART}
SELECT e.event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN {_FENCE} THEN value END), 6) AS whisker_lo,
  round(max(CASE WHEN {_FENCE} THEN value END), 6) AS whisker_hi,
  CAST(count(*) AS BIGINT) AS n, CAST(count_if(NOT ({_FENCE})) AS BIGINT) AS n_outliers,
  round(q3 - q1, 6) AS iqr
FROM events e JOIN q USING (event_type) WHERE value IS NOT NULL GROUP BY e.event_type, q1, median, q3""")
def q_box_stats(spark, sf):
    return r6(H.box_stats(S.load(spark, sf, "events"), "value", "event_type"))


@register("iqr_outliers", f"""WITH {_QUART}
SELECT e.* FROM events e JOIN q USING (event_type) WHERE NOT ({_FENCE})""")
def q_iqr_outliers(spark, sf):
    return C.iqr_outliers(S.load(spark, sf, "events"), "value", "event_type")


def _kde_sql(grid: int, by: str | None) -> str:
    k = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    join = f"JOIN events e USING ({by})" if by else ", events e"
    return f"""WITH s AS (SELECT {k}count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi
             FROM events WHERE value IS NOT NULL {gb}),
h AS (SELECT {k}n, sd * pow(n, -0.2) AS h, lo - 3 * (sd * pow(n, -0.2)) AS start,
             (hi - lo + 6 * (sd * pow(n, -0.2))) / {grid - 1} AS step FROM s),
g AS (SELECT {k}CAST(range AS INTEGER) AS point, start + range * step AS y, h, n FROM range({grid}), h)
SELECT {k.replace(', ', '') + ', ' if by else ''}point, round(y, 6) AS y,
       round(sum(exp(-0.5 * ((y - e.value) / h) * ((y - e.value) / h))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM g {join} WHERE e.value IS NOT NULL GROUP BY {k}point, y, h, n"""


@register("kde_curve", _kde_sql(200, None))
def q_kde_curve(spark, sf):
    return r6(H.kde(S.load(spark, sf, "events"), "value", grid=200))


@register("violin_stats", f"""WITH {_QUART}, d AS ({_kde_sql(100, 'event_type')})
SELECT d.*, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM d JOIN q USING (event_type)""")
def q_violin_stats(spark, sf):
    return r6(H.violin_stats(S.load(spark, sf, "events"), "value", "event_type", grid=100))


@register("histogram", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem
                                   WHERE l_extendedprice IS NOT NULL),
c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS cnt
      FROM lineitem, s WHERE l_extendedprice IS NOT NULL GROUP BY 1),
b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))
SELECT b.bin, round(lo + b.bin * ((hi - lo) / 20), 6) AS lo, round(lo + (b.bin + 1) * ((hi - lo) / 20), 6) AS hi,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count FROM b CROSS JOIN s LEFT JOIN c USING (bin)""")
def q_histogram(spark, sf):
    return r6(H.histogram(S.load(spark, sf, "lineitem"), "l_extendedprice", 20))


def _bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    return f"CAST(coalesce(least(floor(({x} - {lo}) / (({hi} - {lo}) / {bins})), {bins - 1}), 0) AS INTEGER)"


@register("scatter_bins", f"""WITH s AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh,
                                   min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem
                                   WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
b AS (SELECT {_bin_sql('l_quantity', 'xl', 'xh', 50)} AS bx, {_bin_sql('l_extendedprice', 'yl', 'yh', 50)} AS "by",
             l_returnflag, xl, xh, yl, yh FROM lineitem, s
      WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)
SELECT bx, "by", l_returnflag, round(xl + bx * (xh - xl) / 50, 6) AS x_lo, round(yl + "by" * (yh - yl) / 50, 6) AS y_lo,
       count(*) AS count FROM b GROUP BY bx, "by", l_returnflag, xl, xh, yl, yh""")
def q_scatter_bins(spark, sf):
    return r6(H.scatter_bins(S.load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", 50))


PG_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
_PG_STATS = "WITH s AS (SELECT " + ", ".join(
    f"min({c}) AS l{i}, max({c}) AS h{i}" for i, c in enumerate(PG_COLS)) + " FROM lineitem)\n"


@register("pair_grid", _PG_STATS + _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_bin_sql(a, f'l{i}', f'h{i}', 20)} AS bin_a, "
    f"{_bin_sql(b, f'l{j}', f'h{j}', 20)} AS bin_b, count(*) AS count FROM lineitem, s "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 3, 4"
    for i, a in enumerate(PG_COLS) for j, b in enumerate(PG_COLS)]))
def q_pair_grid(spark, sf):
    return H.pair_grid(S.load(spark, sf, "lineitem"), PG_COLS, 20)


@register("line_series", """SELECT CAST(ts AS DATE) AS day, count(value) AS n, round(avg(value), 6) AS mean,
  round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS lo,
  round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS hi
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def q_line_series(spark, sf):
    from pyspark.sql import functions as F
    return r6(H.line_series(S.load(spark, sf, "events"), F.to_date("ts"), "value", x_name="day"))


SUM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("summary_stats", _union([
    f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS count, {_dbl(f'avg({c})')} AS mean, "
    f"{_dbl(f'stddev_samp({c})')} AS std, {_dbl(f'min({c})')} AS min, {_dbl(f'quantile_cont({c}, 0.25)')} AS q25, "
    f"{_dbl(f'quantile_cont({c}, 0.5)')} AS q50, {_dbl(f'quantile_cont({c}, 0.75)')} AS q75, "
    f"{_dbl(f'max({c})')} AS max FROM lineitem" for i, c in enumerate(SUM_COLS)]))
def q_summary_stats(spark, sf):
    return r6(H.summary_stats(S.load(spark, sf, "lineitem"), SUM_COLS))


# --------------------------------------------------------------------------
# Metrics on fixed scores (M12-M18, M21, Y6) — no model involved
# --------------------------------------------------------------------------
from tessera.operators import metrics as M  # noqa: E402
from tessera.operators import features as K  # noqa: E402


@register("confusion_matrix", with_ctes("""
, c AS (SELECT y AS v FROM scored_lines UNION SELECT pred FROM scored_lines)
SELECT a.v AS label, b.v AS prediction, CAST(count(s.y) AS BIGINT) AS count
FROM c a CROSS JOIN c b LEFT JOIN scored_lines s ON s.y = a.v AND s.pred = b.v GROUP BY 1, 2""", "scored_lines"))
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(S.scored_lines(spark, sf), "y", "pred")


@register("accuracy", with_ctes(
    "SELECT count(*) AS n, round(avg(CAST(y = pred AS DOUBLE)), 6) AS accuracy FROM scored_lines", "scored_lines"))
def q_accuracy(spark, sf):
    return r6(M.accuracy(S.scored_lines(spark, sf), "y", "pred"))


_PER_CLASS = """
, cl AS (SELECT y AS class, count(*) AS support, count_if(y = pred) AS tp FROM scored_lines GROUP BY 1),
pr AS (SELECT pred AS class, count(*) AS predicted FROM scored_lines GROUP BY 1),
pc AS (SELECT coalesce(cl.class, pr.class) AS class, CAST(coalesce(support, 0) AS BIGINT) AS support,
              CAST(coalesce(predicted, 0) AS BIGINT) AS predicted, CAST(coalesce(tp, 0) AS BIGINT) AS tp
       FROM cl FULL OUTER JOIN pr ON cl.class = pr.class),
pm AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
              CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END AS f1 FROM pc)"""


@register("precision_recall", with_ctes(_PER_CLASS + """
SELECT class, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM pm""", "scored_lines"))
def q_precision_recall(spark, sf):
    return r6(M.per_class(S.scored_lines(spark, sf), "y", "pred"))


@register("weighted_f1", with_ctes(_PER_CLASS + """
SELECT round(sum(support * f1) / sum(support), 6) AS weighted_f1 FROM pm""", "scored_lines"))
def q_weighted_f1(spark, sf):
    return r6(M.weighted_f1(S.scored_lines(spark, sf), "y", "pred"))


_SCORE_COUNTS = """
, sc AS (SELECT score, sum(CAST(y AS INTEGER)) AS pos, sum(1 - CAST(y AS INTEGER)) AS neg
         FROM scored_lines WHERE score IS NOT NULL GROUP BY score)"""


@register("roc_auc", with_ctes(_SCORE_COUNTS + """,
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM sc)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM r""", "scored_lines"))
def q_roc_auc(spark, sf):
    return r6(M.roc_auc(S.scored_lines(spark, sf), "y", "score"))


_CUM = """,
r AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc)"""


@register("roc_curve", with_ctes(_SCORE_COUNTS + _CUM + """
SELECT round(score, 6) AS threshold, round(cn / N, 6) AS fpr, round(cp / P, 6) AS tpr FROM r""", "scored_lines"))
def q_roc_curve(spark, sf):
    return r6(M.roc_curve(S.scored_lines(spark, sf), "y", "score"))


@register("pr_curve", with_ctes(_SCORE_COUNTS + _CUM + """
SELECT round(score, 6) AS threshold, round(cp / (cp + cn), 6) AS precision, round(cp / P, 6) AS recall FROM r""",
                                "scored_lines"))
def q_pr_curve(spark, sf):
    return r6(M.pr_curve(S.scored_lines(spark, sf), "y", "score"))


_REG_SQL = """SELECT 3 * l_quantity + 0.001 * l_extendedprice + CAST(l_orderkey % 17 - 8 AS DOUBLE) AS y,
       3 * l_quantity + 0.001 * l_extendedprice AS p FROM lineitem"""


@register("mse", f"SELECT count(y - p) AS n, round(avg((y - p) * (y - p)), 6) AS mse FROM ({_REG_SQL}) t")
def q_mse(spark, sf):
    from pyspark.sql import functions as F
    d = S.reg_rows(spark, sf).withColumn("p", 3 * F.col("l_quantity") + 0.001 * F.col("l_extendedprice"))
    return r6(M.mse(d, "y", "p"))


def _hash_sql(id_sql: str, buckets: int, seed: int) -> str:
    return f"CAST(CAST('0x' || substr(md5('{seed}' || CAST({id_sql} AS VARCHAR)), 1, 8) AS BIGINT) % {buckets} AS INTEGER)"


@register("cv_metrics", with_ctes(f"""
SELECT {_hash_sql('l_orderkey', 5, 43)} AS fold, count(*) AS n, round(avg(CAST(y = pred AS DOUBLE)), 6) AS accuracy
FROM scored_lines GROUP BY 1""", "scored_lines"))
def q_cv_metrics(spark, sf):
    d = K.add_folds(S.scored_lines(spark, sf), "l_orderkey", 5, seed=42)
    return r6(M.metrics_by_fold(d, "y", "pred"))


@register("best_model", with_ctes("""
, lb AS (SELECT printf('score>=%.2f', t) AS model, t AS threshold,
                avg(CAST(CAST(score >= t AS INTEGER) = CAST(y AS INTEGER) AS DOUBLE)) AS accuracy
         FROM scored_lines, (VALUES (CAST(0.2 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.8 AS DOUBLE))) v(t) GROUP BY t)
SELECT model, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy FROM lb
ORDER BY accuracy DESC, model LIMIT 1""", "scored_lines"))
def q_best_model(spark, sf):
    lb = M.threshold_leaderboard(S.scored_lines(spark, sf), "y", "score", [0.2, 0.5, 0.8])
    return r6(M.best_model(lb, "accuracy"))


@register("train_test_split", f"""SELECT c_custkey,
  CASE WHEN {_hash_sql('c_custkey', 100, 42)} < 20 THEN 'test' ELSE 'train' END AS split FROM customer""")
def q_train_test_split(spark, sf):
    return K.train_test_split(S.load(spark, sf, "customer"), "c_custkey", 20, 42).select("c_custkey", "split")


# every usable column of the table in its order; the text one as its code
AN_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
           "l_linestatus"]
_AN_ROWS = ("(SELECT * REPLACE (dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus) FROM lineitem "
            "WHERE l_returnflag IS NOT NULL) AS li")


def _anova_sql() -> str:
    m = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(AN_COLS))
    g = ", ".join(f"sum({c} - m{i}) AS s{i}, sum(({c} - m{i}) * ({c} - m{i})) AS q{i}" for i, c in enumerate(AN_COLS))
    t = ", ".join(f"sum(s{i} * s{i} / n) AS b{i}, sum(s{i}) AS ss{i}, sum(q{i}) AS qq{i}" for i in range(len(AN_COLS)))
    parts = [f"SELECT {i} AS position, '{c}' AS \"column\", "
             f"round(((b{i} - ss{i} * ss{i} / N) / (k - 1)) / ((qq{i} - b{i}) / (N - k)), 6) AS f_value FROM t"
             for i, c in enumerate(AN_COLS)]
    return (f"WITH m AS (SELECT {m} FROM {_AN_ROWS}),\n"
            f"g AS (SELECT l_returnflag, count(*) AS n, {g} FROM {_AN_ROWS}, m GROUP BY 1),\n"
            f"t AS (SELECT sum(n) AS N, count(*) AS k, {t} FROM g)\n" + _union(parts))


@register("anova_f", _anova_sql())
def q_anova_f(spark, sf):
    return r6(K.anova_f(S.load(spark, sf, "lineitem"), "l_returnflag"))


@register("select_k_best", "WITH f AS (" + _anova_sql() + """)
SELECT CAST(row_number() OVER (ORDER BY f_value DESC NULLS LAST, position) AS INTEGER) AS rank, "column", f_value
FROM f ORDER BY f_value DESC NULLS LAST, position LIMIT 4""")
def q_select_k_best(spark, sf):
    return r6(K.select_k_best(S.load(spark, sf, "lineitem"), "l_returnflag", 4))


MI_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("mutual_info", "WITH s AS (SELECT " + ", ".join(
    f"min({c}) AS l{i}, max({c}) AS h{i}" for i, c in enumerate(MI_COLS)) + " FROM lineitem WHERE l_returnflag IS NOT NULL),\n"
    "st AS (" + _union([
        f"SELECT {i} AS position, '{c}' AS \"column\", {_bin_sql(c, f'l{i}', f'h{i}', 10)} AS bin, l_returnflag AS y "
        f"FROM lineitem, s WHERE l_returnflag IS NOT NULL AND {c} IS NOT NULL" for i, c in enumerate(MI_COLS)]) + "),\n"
    """j AS (SELECT position, "column", bin, y, count(*) AS nxy FROM st GROUP BY 1, 2, 3, 4),
px AS (SELECT position, bin, sum(nxy) AS nx FROM j GROUP BY 1, 2),
py AS (SELECT position, y, sum(nxy) AS ny FROM j GROUP BY 1, 2),
n AS (SELECT position, sum(nxy) AS n FROM j GROUP BY 1)
SELECT j.position, "column", round(sum((nxy / n) * ln((nxy * n) / (nx * ny))), 6) AS mi
FROM j JOIN px USING (position, bin) JOIN py USING (position, y) JOIN n USING (position) GROUP BY 1, 2""")
def q_mutual_info(spark, sf):
    return r6(K.mutual_info(S.load(spark, sf, "lineitem"), "l_returnflag", MI_COLS, 10))


# --------------------------------------------------------------------------
# Wizard, reports, sources, text
# --------------------------------------------------------------------------
from tessera.plans.cleaning import CleaningPlan  # noqa: E402
from tessera.plans import reports as RPT  # noqa: E402


def wizard_plan() -> CleaningPlan:
    return (CleaningPlan(checkpoint_every=2).missing("impute").outliers("o_totalprice", "cap")
            .encode("label").transform("o_totalprice", "standard"))


@register("clean_wizard", with_ctes("""
, m AS (SELECT avg(o_totalprice) AS mp FROM orders_missing),
md AS (SELECT o_orderpriority AS v FROM orders_missing WHERE o_orderpriority IS NOT NULL
       GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
s1 AS (SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(o_totalprice, mp) AS o_totalprice, o_orderdate,
              coalesce(o_orderpriority, md.v) AS o_orderpriority FROM orders_missing, m, md),
st2 AS (SELECT avg(o_totalprice) AS m2, stddev_samp(o_totalprice) AS s2 FROM s1),
s2 AS (SELECT o_orderkey, o_custkey, o_orderstatus, least(greatest(o_totalprice, m2 - 3 * s2), m2 + 3 * s2) AS o_totalprice,
              o_orderdate, o_orderpriority FROM s1, st2),
s3 AS (SELECT o_orderkey, o_custkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus,
              o_totalprice, o_orderdate,
              CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM s2),
st4 AS (SELECT avg(o_totalprice) AS m4, stddev_samp(o_totalprice) AS s4 FROM s3)
SELECT o_orderkey, o_custkey, o_orderstatus, round((o_totalprice - m4) / s4, 6) AS o_totalprice, o_orderdate,
       o_orderpriority FROM s3, st4""", "orders_missing"))
def q_clean_wizard(spark, sf):
    return r6(wizard_plan().apply(S.orders_missing(spark, sf)))


_OM_CORR = ["o_orderkey", "o_custkey", "o_totalprice"]


@register("eda_report", with_ctes(_union([
    f"SELECT 'missing' AS section, '{c}' AS key1, CAST(NULL AS VARCHAR) AS key2, "
    f"CAST(count(*) - count({c}) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM orders_missing"
    for c in OM_COLS] + [
    f"SELECT 'correlation', '{a}', '{b}', round(corr({_d(a)}, {_d(b)}), 6), NULL FROM orders_missing"
    for a in _OM_CORR for b in _OM_CORR] + [
    f"SELECT 'recommendation', rule, NULL, NULL, detail FROM ({_REC_BODY}) r"]), "orders_missing"))
def q_eda_report(spark, sf):
    return r6(RPT.eda_report(S.orders_missing(spark, sf), "o_orderstatus"))


from tessera.sources import csv_io as IO  # noqa: E402
from tessera.functions import text as TX  # noqa: E402
from tessera.session import scratch_dir  # noqa: E402


@register("read_csv_roundtrip", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
          "round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def q_read_csv_roundtrip(spark, sf):
    path = IO.write_csv(S.load(spark, sf, "customer"), scratch_dir(spark, "csv-roundtrip"))
    return r6(IO.read_table(spark, path))


_NOTE = "concat(' ', c_name, ', \"', c_mktsegment, '\"', chr(10), '\"\"', c_nationkey, chr(92), ' ')"


@register("read_csv_quoted", f"SELECT c_custkey, {_NOTE} AS note, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS seg "
          "FROM customer")
def q_read_csv_quoted(spark, sf):
    """Quotes, commas, line breaks, backslashes, outer blanks and holes come
    back as they were written."""
    from pyspark.sql import functions as F
    c = S.load(spark, sf, "customer").select("c_custkey", F.expr(_NOTE).alias("note"), F.expr(
        "CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment WHEN c_custkey % 3 = 2 THEN c_mktsegment END").alias("seg"))
    return IO.read_table(spark, IO.write_csv(c, scratch_dir(spark, "csv-quoted")), multi_line=True)


# the table's texts hold no code: every reply gets none, one or two blocks
# (one of them over an empty line), or an unclosed one, by its key
_FENCED = """CASE (conv_id + turn) % 5
    WHEN 0 THEN text
    WHEN 1 THEN concat(text, chr(10), '```python', chr(10), 'x = ', conv_id, chr(10), '```', chr(10), text)
    WHEN 2 THEN concat('```python', chr(10), 'a = ', turn, chr(10), chr(10), 'b', chr(10), '```', text,
                       '```python', chr(10), 'second', chr(10), '```')
    WHEN 3 THEN concat(text, '```python', chr(10), 'never closed')
    ELSE concat('```sql', chr(10), 'SELECT 1', chr(10), '```') END"""


@register("extract_code_blocks", "SELECT conv_id, turn, regexp_extract(text, '(?s)```python\\n(.*?)\\n```', 1) AS code "
          f"FROM (SELECT conv_id, turn, {_FENCED} AS text FROM conversations WHERE role = 'assistant')")
def q_extract_code_blocks(spark, sf):
    from pyspark.sql import functions as F
    c = S.load(spark, sf, "conversations").where(F.col("role") == "assistant").withColumn("text", F.expr(_FENCED))
    return TX.extract_code_blocks(c, "text").select("conv_id", "turn", "code")


@register("chat_context", """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS position,
       role, text FROM conversations
UNION ALL SELECT DISTINCT conv_id, 0, 'system', 'You write Python.' FROM conversations
UNION ALL SELECT conv_id, count(*) + 1, 'user', 'Plot it.' FROM conversations GROUP BY conv_id""")
def q_chat_context(spark, sf):
    return TX.chat_context(S.load(spark, sf, "conversations"), "You write Python.", "Plot it.")


# --------------------------------------------------------------------------
# Training, scoring (M2-M12, M19-M22, K2, X6, Y4, Y5) — rows-only checks
# except the closed-form ones
# --------------------------------------------------------------------------
from tessera.operators import models as ML  # noqa: E402
from tessera.operators import score as SC  # noqa: E402

MODEL_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


@register("linear_regression", "SELECT round(regr_slope(p_retailprice, p_partkey), 6) AS slope, "
          "round(regr_intercept(p_retailprice, p_partkey), 6) AS intercept FROM part")
def q_linear_regression(spark, sf):
    p = S.load(spark, sf, "part")
    m = SC.fit_scoring_model(p, ["p_partkey"], "p_retailprice", "linear_regression", task="regression").stages[-1]
    return r6(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))],
                                    "slope double, intercept double"))


_DEF_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@register("default_row", with_ctes(_union([
    f"SELECT {i} AS position, '{c}' AS \"column\", round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
    f"CAST(NULL AS VARCHAR) AS mode FROM orders_missing"
    for i, c in enumerate(_DEF_COLS) if c not in ("o_orderstatus", "o_orderpriority")] + [
    f"SELECT {i}, '{c}', NULL, (SELECT {c} FROM orders_missing WHERE {c} IS NOT NULL GROUP BY 1 "
    f"ORDER BY count(*) DESC, 1 LIMIT 1)"
    for i, c in enumerate(_DEF_COLS) if c in ("o_orderstatus", "o_orderpriority")]), "orders_missing"))
def q_default_row(spark, sf):
    return r6(SC.default_values(S.orders_missing(spark, sf), _DEF_COLS))


def _model_split(spark, sf):
    from pyspark.sql import functions as F
    d = K.train_test_split(S.model_rows(spark, sf).withColumn(
        "row_id", F.col("l_orderkey") * 100 + F.col("l_linenumber")), "l_orderkey", 20, 42)
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


@register("score_batch")
def q_score_batch(spark, sf):
    """Fit on all rows and score all rows, holes filled with the defaults."""
    rows = S.model_rows(spark, sf)
    m = SC.fit_scoring_model(rows, MODEL_FEATURES, "label", "random_forest", task="classification", trees=100, depth=5)
    filled = SC.fill_defaults(rows, SC.default_values(rows, MODEL_FEATURES))
    return SC.score_batch(m, filled, keep=["l_orderkey", "l_linenumber", "label"])


@register("fill_defaults", with_ctes("""SELECT o_orderkey, round(coalesce(o_totalprice,
       (SELECT avg(o_totalprice) FROM orders_missing)), 6) AS o_totalprice, coalesce(o_orderpriority,
       (SELECT o_orderpriority FROM orders_missing WHERE o_orderpriority IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM orders_missing""", "orders_missing"))
def q_fill_defaults(spark, sf):
    rows = S.orders_missing(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority")
    return r6(SC.fill_defaults(rows, SC.default_values(rows, ["o_totalprice", "o_orderpriority"])))


@register("automl")
def q_automl(spark, sf):
    d = S.model_rows(spark, sf)
    return ML.automl(d, MODEL_FEATURES, "label", "l_orderkey", grid="full").leaderboard


@register("automl_regression")
def q_automl_regression(spark, sf):
    d = S.reg_rows(spark, sf)
    return ML.automl(d, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "y", "l_orderkey",
                     grid="full").leaderboard


@register("compare_models")
def q_compare_models(spark, sf):
    d = S.model_rows(spark, sf)
    # linear_regression on a class target is reported as an error row, as the
    # original allowed that pairing
    return ML.compare_models(d, MODEL_FEATURES, "label", "l_orderkey",
                             ["logistic_regression", "random_forest", "decision_tree", "svm",
                              "gradient_boosting", "boosted_trees", "linear_regression"]).leaderboard


_CURVES = {"as_is": ("score", "pred"), "turned": ("1.0 - score", "NOT pred")}


@register("compared_curves", with_ctes("""SELECT * FROM (WITH s AS (""" + _union([
    f"SELECT '{m}' AS model, CAST(CAST(y AS INTEGER) AS DOUBLE) AS label, CAST(CAST({p} AS INTEGER) AS DOUBLE) AS prediction, CAST({x} AS DOUBLE) AS score FROM scored_lines"
    for m, (x, p) in _CURVES.items()]) + """),
b AS (SELECT model, least(floor(score * 1000), 999) AS b, count(*) FILTER (label = 1) AS p, count(*) AS c FROM s WHERE score IS NOT NULL GROUP BY ALL),
r AS (SELECT model, sum(p) OVER above AS tp, sum(c) OVER above AS n, sum(p) OVER whole AS pos, sum(c) OVER whole AS total FROM b
      WINDOW above AS (PARTITION BY model ORDER BY b DESC), whole AS (PARTITION BY model))
SELECT model, 'confusion' AS chart, label AS x, prediction AS y, count(*) AS n FROM s GROUP BY ALL
UNION ALL SELECT model, 'roc', round((n - tp) / (total - pos), 6), round(tp / pos, 6), CAST(n AS BIGINT) FROM r WHERE pos > 0 AND total > pos
UNION ALL SELECT model, 'pr', round(tp / pos, 6), round(tp / n, 6), CAST(n AS BIGINT) FROM r WHERE pos > 0)""", "scored_lines"))
def q_compared_curves(spark, sf):
    """M20 charts of two scorings of every line: as it is, and turned round."""
    from functools import reduce

    from pyspark.sql import functions as F
    rows = S.scored_lines(spark, sf)
    parts = [rows.select(F.lit(m).alias("model"), F.col("y").cast("int").cast("double").alias("label"),
                         F.expr(p).cast("int").cast("double").alias("prediction"), F.expr(x).cast("double").alias("score"))
             for m, (x, p) in _CURVES.items()]
    return r6(ML.compared_curves(reduce(lambda a, b: a.unionByName(b), parts)))


@register("fold_linear_fits", _union([
    f"SELECT {f} AS fold, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept "
    f"FROM part WHERE p_partkey % 3 <> {f}" for f in range(3)]))
def q_fold_linear_fits(spark, sf):
    """Least squares of every fold's other rows, from one shared pass."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from tessera.operators import grid as GR
    from tessera.operators import shared as SH
    rows = S.load(spark, sf, "part").select(
        array_to_vector(F.array(F.col("p_size").cast("double"))).alias("features"), F.col("p_retailprice").cast("double").alias("label"),
        F.lit(0).alias("split"), (F.col("p_partkey") % 3).alias("fold"), F.col("p_partkey").cast("long").alias("key"))
    blocks, cuts = SH.pack(rows, "features", "label")
    task = GR.Task(blocks, cuts, 0, SH.fits(3))
    space, got = task.spaces["linear"], GR.least_squares(task).coefficients
    out = []
    for f in range(3):
        slope = float(got[f + 1, 0, 0][0, 0] / space.scale[0])
        out.append((f, slope, float(got[f + 1, 0, 0][1, 0] - slope * space.mean[0])))
    return r6(spark.createDataFrame(out, "fold int, slope double, intercept double"))


@register("feature_importances")
def q_feature_importances(spark, sf):
    m = SC.fit_scoring_model(S.model_rows(spark, sf), MODEL_FEATURES, "label", "random_forest", task="classification",
                             trees=100, depth=5)
    return ML.feature_importances(m.stages[-2], MODEL_FEATURES)


@register("rfe")
def q_rfe(spark, sf):
    rows = S.model_rows(spark, sf)
    return ML.rfe(rows, [c for c in rows.columns if c not in ("l_orderkey", "label")], "label", 2, task="classification")


@register("pca")
def q_pca(spark, sf):
    rows, _ = ML.pca(S.load(spark, sf, "embeddings"), "embedding", 5, id_col="vec_id")
    return rows


# --------------------------------------------------------------------------
# Anomaly detection
# --------------------------------------------------------------------------
from tessera.operators import anomaly as AN  # noqa: E402


def _part_xy(spark, sf):
    from pyspark.sql import functions as F
    p = S.load(spark, sf, "part")
    return p.withColumn("dx", F.col("p_size").cast("double")).withColumn("dy", F.col("p_retailprice") / 10)


@register("dbscan_noise", """WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 10 AS y FROM part),
nb AS (SELECT a.id AS p, b.id AS q FROM p a JOIN p b
       ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25),
cnt AS (SELECT p, count(*) AS n FROM nb GROUP BY p),
core AS (SELECT p AS id FROM cnt WHERE n >= 5),
noise AS (SELECT id FROM p WHERE id NOT IN (SELECT id FROM core)
          AND id NOT IN (SELECT nb.p FROM nb JOIN core ON nb.q = core.id))
SELECT * FROM part WHERE p_partkey IN (SELECT id FROM noise)""")
def q_dbscan_noise(spark, sf):
    return AN.dbscan_noise(_part_xy(spark, sf), "p_partkey", ["dx", "dy"], 0.5, 5).drop("dx", "dy")


@register("dbscan_clusters")
def q_dbscan_clusters(spark, sf):
    return AN.dbscan_labels(_part_xy(spark, sf), "p_partkey", ["dx", "dy"], 0.5, 5)


@register("isolation_forest")
def q_isolation_forest(spark, sf):
    return AN.isolation_forest(S.load(spark, sf, "events"), id_col="event_id", contamination=0.05)


# --------------------------------------------------------------------------
# Explanation (X1-X5, S8) — rows-only; properties are tested in pytest
# --------------------------------------------------------------------------
from tessera.operators import explain as EX  # noqa: E402

EXPLAIN_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _explain_rows(spark, sf):
    """``row_id`` hashes every column, so identical rows share an id (they are
    interchangeable)."""
    from pyspark.sql import functions as F
    d = S.model_rows(spark, sf)
    return d.withColumn("row_id", F.xxhash64(*[F.col(c) for c in d.columns]))


def _explain_setup(spark, sf, trees: int = 100, depth: int = 5):
    """Forest (the original's default size) on the train split of
    ``model_rows``; the test split is explained."""
    from pyspark.sql import functions as F
    d = K.train_test_split(_explain_rows(spark, sf), "l_orderkey", 20, 42)
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    model = SC.fit_scoring_model(train, EXPLAIN_FEATURES, "label", "random_forest", task="classification",
                                 trees=trees, depth=depth)
    return model, train, test


@register("tree_shap")
def q_tree_shap(spark, sf):
    model, _, test = _explain_setup(spark, sf)
    shap, _ = EX.tree_shap(model, test, "row_id", EXPLAIN_FEATURES)
    return shap


@register("shap_importance")
def q_shap_importance(spark, sf):
    model, _, test = _explain_setup(spark, sf)
    return EX.shap_importance(EX.tree_shap(model, test, "row_id", EXPLAIN_FEATURES)[0])


def _permuted_rows(test):
    """The columns that the model and its score read, the label as text."""
    from pyspark.sql import functions as F
    return test.select("row_id", *EXPLAIN_FEATURES, F.col("label").cast("string").alias("label"))


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    model, _, test = _explain_setup(spark, sf)
    return EX.permutation_importance(model, _permuted_rows(test), EXPLAIN_FEATURES, "label", "row_id", "classification", 5)


@register("lime_rows")
def q_lime_rows(spark, sf):
    """Explains the rows that a user names: here the line of the largest
    extended price among the test rows, as in ``shap_row``."""
    from pyspark.sql import functions as F
    model, train, test = _explain_setup(spark, sf)
    chosen = test.orderBy(F.desc("l_extendedprice"), F.asc("row_id")).limit(1)
    return EX.lime_rows(model, train, chosen, EXPLAIN_FEATURES, "row_id", n=5000, top=5)


@register("explanation_report")
def q_explanation_report(spark, sf):
    model, _, test = _explain_setup(spark, sf)
    imp = EX.shap_importance(EX.tree_shap(model, test, "row_id", EXPLAIN_FEATURES)[0])
    perm = EX.permutation_importance(model, _permuted_rows(test), EXPLAIN_FEATURES, "label", "row_id", "classification", 5)
    return RPT.explanation_report(imp, perm)


# --------------------------------------------------------------------------
# Streaming
# --------------------------------------------------------------------------
from tessera.streaming import score_stream as ST  # noqa: E402


@register("score_stream")
def q_score_stream(spark, sf):
    """Train on the train split; all rows land as Parquet files in the shared
    scratch folder and are scored by a file stream (availableNow).  They land
    from one scan; put together from the two splits the table would be read and
    its split hashed twice."""
    model, _, _ = _explain_setup(spark, sf)
    landing = scratch_dir(spark, "landing")
    raw = _explain_rows(spark, sf).select("row_id", *EXPLAIN_FEATURES)
    spread(raw).write.option("maxRecordsPerFile", 1_000_000).parquet(landing)
    return ST.score_stream(spark, model, landing, raw.schema, keep=["row_id", *EXPLAIN_FEATURES])


def wizard_plan_customer() -> CleaningPlan:
    return (CleaningPlan(checkpoint_every=2).missing("impute").outliers("c_acctbal", "cap")
            .encode("label").transform("c_acctbal", "standard"))


@register("clean_wizard_customer", """WITH st AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer),
s2 AS (SELECT c_custkey, c_name, c_nationkey, least(greatest(c_acctbal, m - 3 * s), m + 3 * s) AS c_acctbal,
              c_mktsegment FROM customer, st),
s3 AS (SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name, c_nationkey, c_acctbal,
              CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment FROM s2),
st4 AS (SELECT avg(c_acctbal) AS m4, stddev_samp(c_acctbal) AS s4 FROM s3)
SELECT c_custkey, c_name, c_nationkey, round((c_acctbal - m4) / s4, 6) AS c_acctbal, c_mktsegment FROM s3, st4""")
def q_clean_wizard_customer(spark, sf):
    return r6(wizard_plan_customer().apply(S.load(spark, sf, "customer")))


@register("shap_row")
def q_shap_row(spark, sf):
    """Force-plot data of the test row with the largest extended price
    (ties: smallest row id) — SHAP values plus the base value per class."""
    from pyspark.sql import functions as F
    model, _, test = _explain_setup(spark, sf)
    top = test.orderBy(F.desc("l_extendedprice"), F.asc("row_id")).limit(1)
    shap, base = EX.tree_shap(model, top, "row_id", EXPLAIN_FEATURES)
    row_id = top.select("row_id").first()[0]
    return EX.shap_row(shap, base, "row_id", row_id)
