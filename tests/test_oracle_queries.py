"""Every registered query that has a SQL oracle equals DuckDB on the same
Parquet files (sf0.001 here; the external gate runs sf0.01)."""
import importlib.util
import os

import pytest

from conftest import ROOT, SF_SMALL

spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
entry_mod = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_mod)
ORACLE = entry_mod.oracle_sql()
QUERIES = entry_mod.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 6
    assert df.columns == ["position", "column", "dtype", "missing", "missing_pct", "unique"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    from tessera.plans.oracle_check import compare
    res = compare(QUERIES[name](spark, SF_SMALL), SF_SMALL, ORACLE[name])
    assert res["match"], res
