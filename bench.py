"""

Runs each workload at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8), forcing full execution with a ``noop``
write (no collect), and prints ONE JSON line:

    {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

``BENCH_REPEAT`` (default 1) > 1 reports the median of that many timed runs
after one warm-up run of the whole set.  ``BENCH_ONLY`` = comma list of
workload names to run a subset.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def _workloads():
    from pyspark.sql import functions as F

    from tessera.operators import anomaly as AN
    from tessera.operators import charts as H
    from tessera.operators import explain as EX
    from tessera.operators import models as ML
    from tessera.operators import profile as G
    from tessera.plans import workloads as W
    from tessera.sources import tables as S

    def profile(approx):
        return lambda spark, sf: G.column_profile(S.load(spark, sf, "lineitem"), approx=approx)

    def box(approx):
        return lambda spark, sf: H.box_stats(S.load(spark, sf, "events"), "value", "event_type", approx=approx)

    def automl(spark, sf):
        return ML.automl(S.model_rows(spark, sf), W.MODEL_FEATURES, "label", "l_orderkey",
                         grid="full").leaderboard

    def tree_shap(spark, sf):
        model, _, test = W._explain_setup(spark, sf, trees=100, depth=5)
        return EX.tree_shap(model, test, "row_id", W.EXPLAIN_FEATURES)[0]

    def perm(spark, sf):
        model, _, test = W._explain_setup(spark, sf, trees=20)
        t = test.withColumn("label", F.col("label").cast("string"))
        return EX.permutation_importance(model, t, W.EXPLAIN_FEATURES, "label", "row_id", "classification", 5)

    return {
        "column_profile": profile(False),
        "column_profile_approx": profile(True),
        "correlation_matrix": lambda spark, sf: G.correlation_matrix(S.load(spark, sf, "lineitem")),
        "outlier_counts": lambda spark, sf: G.outlier_counts(S.load(spark, sf, "events")),
        "clean_wizard": W.QUERIES["clean_wizard"],
        "clean_wizard_customer": lambda spark, sf: W.wizard_plan_customer().apply(S.load(spark, sf, "customer")),
        "box_stats": box(False),
        "box_stats_approx": box(True),
        "histogram_kde": lambda spark, sf: H.kde(S.load(spark, sf, "events"), "value", grid=200),
        "roc_curve": W.QUERIES["roc_curve"],
        "label_encode": W.QUERIES["label_encode"],
        "dbscan_noise": W.QUERIES["dbscan_noise"],
        "isolation_forest": lambda spark, sf: AN.isolation_forest(S.load(spark, sf, "events"), id_col="event_id"),
        "automl_full_grid": automl,
        "tree_shap": tree_shap,
        "permutation_importance": perm,
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    from tessera.session import build_session
    spark = build_session(f"local[{cpus}]", app_name="tessera-bench", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "16g",
                                 "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tessera-bench-ckpt-")})
    work = _workloads()
    names = [n for n in work if not only or n in only]

    errors: dict[str, str] = {}

    def run(name):
        t0 = time.perf_counter()
        try:
            df = work[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
        except Exception as e:  # report, keep measuring the others
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            return float("nan")
        return time.perf_counter() - t0

    # JVM and Python worker warm-up on a tiny job
    spark.range(1000).selectExpr("sum(id)").collect()
    timings: dict[str, list[float]] = {n: [] for n in names}
    if repeat > 1:
        for n in names:
            run(n)
    for _ in range(repeat):
        for n in names:
            timings[n].append(run(n))
    queries = {n: (None if n in errors else round(statistics.median(v), 3)) for n, v in timings.items()}
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(v for v in queries.values() if v is not None), 3),
           "unit": "sec", "queries": queries, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
           "repeat": repeat}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
