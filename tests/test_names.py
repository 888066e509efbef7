"""Column names with dots and blanks through the table operators."""
import pytest
from pyspark.sql import functions as F

from tessera.operators import clean as C
from tessera.operators import profile as G
from tessera.operators import select as P
from tessera.session import scratch_dir
from tessera.sources import csv_io

N, T = "price.usd", "my name"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, float(i % 7) if i % 5 else None, "abc"[i % 3] if i % 4 else None) for i in range(40)]
    return spark.createDataFrame(rows, f"id long, `{N}` double, `{T}` string")


CASES = {
    "missing_counts": lambda d: G.missing_counts(d), "missing_pct": lambda d: G.missing_pct(d), "unique_counts": lambda d: G.unique_counts(d),
    "column_profile": lambda d: G.column_profile(d), "column_stats": lambda d: G.column_stats(d), "mode_value": lambda d: G.mode_value(d, T),
    "group_agg": lambda d: G.group_agg(d, T, N, "mean"), "value_counts": lambda d: G.value_counts(d, T),
    "outlier_counts": lambda d: G.outlier_counts(d), "class_counts": lambda d: G.class_counts(d, T), "detect_task": lambda d: G.detect_task(d, N),
    "correlation_matrix": lambda d: G.correlation_matrix(d), "impute_mean": lambda d: C.impute_mean(d, [N]), "impute_mode": lambda d: C.impute_mode(d, [T]),
    "impute_median": lambda d: C.impute_median(d, [N]), "label_encode": lambda d: C.label_encode(d, [T]), "one_hot": lambda d: C.one_hot(d, [T]),
    "log_transform": lambda d: C.log_transform(d, N), "standard_scale": lambda d: C.standard_scale(d, N), "minmax_scale": lambda d: C.minmax_scale(d, N),
    "filter_exact": lambda d: P.filter_exact(d, N, "3"), "filter_range": lambda d: P.filter_range(d, N, 1, 3), "filter_in": lambda d: P.filter_in(d, T, ["a"]),
    "distinct_values": lambda d: P.distinct_values(d, T), "drop_missing_rows": lambda d: P.drop_missing_rows(d), "outlier_rows": lambda d: P.outlier_rows(d, N),
    "cap_outliers": lambda d: P.cap_outliers(d, N), "select_features": lambda d: P.select_features(d, [N], T), "to_numeric": lambda d: P.to_numeric(d, T),
    "drop_columns": lambda d: P.drop_columns(d, [N]),
}


@pytest.mark.parametrize("case", CASES)
def test_same_as_with_plain_names(odd, case):
    plain = odd.withColumnsRenamed({N: "price_usd", T: "my_name"})
    with_odd = CASES[case](odd).collect()

    def renamed(case):
        names = globals()["N"], globals()["T"]
        globals()["N"], globals()["T"] = "price_usd", "my_name"
        try:
            return CASES[case](plain).collect()
        finally:
            globals()["N"], globals()["T"] = names
    show = lambda rows: sorted(repr(tuple(r)).replace("price_usd", N).replace("my_name", T) for r in rows)
    assert show(with_odd) == show(renamed(case)) and (with_odd or case == "outlier_rows")


def test_csv_header_with_dots(spark, odd):
    path = scratch_dir(spark, "odd-csv")
    csv_io.write_csv(odd, path)
    back = csv_io.read_table(spark, path)
    assert set(back.columns) == set(odd.columns) and back.count() == 40
    assert back.where(F.col(f"`{N}`") == 3.0).count() == odd.where(F.col(f"`{N}`") == 3.0).count()
