"""Compare a Spark result with a DuckDB SQL result on the same Parquet files.

Mirrors the external correctness gate: row count, column names (sorted)
and an order-insensitive hash of values with doubles rounded.  Used by the
test-suite and by ``python -m tessera.plans.oracle_check <sf_dir> [names]``.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys

from tessera.sources.tables import TABLES


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item(), digits)
        except (AttributeError, ValueError):
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def _digest(cols: list[str], rows: list[tuple], digits: int) -> tuple[int, str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    normed = sorted(repr(tuple(_norm(r[i], digits) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(normed).encode()).hexdigest()
    return len(rows), h


def duck_rows(sf_dir: str, sql: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):  # a table is a file or a folder of part files; a test may bring only some
            files = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    rows = [tuple(r) for r in res.fetchall()]
    con.close()
    return cols, rows


def spark_rows(df):
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    return cols, rows


def compare(df, sf_dir: str, sql: str, digits: int = 6) -> dict:
    scols, srows = spark_rows(df)
    dcols, drows = duck_rows(sf_dir, sql)
    out = {"spark_rows": len(srows), "oracle_rows": len(drows),
           "schema_match": sorted(scols) == sorted(dcols)}
    if not out["schema_match"]:
        out["spark_cols"], out["oracle_cols"] = scols, dcols
        out["match"] = False
        return out
    # align oracle column order with Spark's
    idx = [dcols.index(c) for c in scols]
    drows = [tuple(r[i] for i in idx) for r in drows]
    sn, sh = _digest(scols, srows, digits)
    dn, dh = _digest(scols, drows, digits)
    out["match"] = sn == dn and sh == dh
    if not out["match"]:
        order = sorted(range(len(scols)), key=lambda i: scols[i])
        a = sorted(repr(tuple(_norm(r[i], digits) for i in order)) for r in srows)
        b = sorted(repr(tuple(_norm(r[i], digits) for i in order)) for r in drows)
        diff_a = [x for x in a if x not in set(b)][:3]
        diff_b = [x for x in b if x not in set(a)][:3]
        out["spark_only"], out["oracle_only"] = diff_a, diff_b
    return out


def main(argv: list[str]) -> int:
    import importlib.util
    import os
    import time

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(here, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    from tessera.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    qs, oracle = mod.queries(), mod.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in oracle:
                res = compare(df, sf_dir, oracle[name])
            else:
                res = {"rows_only": df.count(), "match": None}
        except Exception as e:  # report and continue
            res = {"error": f"{type(e).__name__}: {str(e)[:400]}", "match": False}
        res["sec"] = round(time.time() - t0, 2)
        if res.get("match") is False:
            bad += 1
        print(name, res, flush=True)
    print(f"mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
