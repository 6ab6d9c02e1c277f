"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line with per-query and total seconds.

Every query is executed to completion with the ``noop`` sink (full
computation, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "qc_by_batch",          # entry 1: QC summary
    "crosstab_prop",        # entry 1: masked label x batch table
    "cap_rows",             # exact-k sampling
    "hvg_batch",            # per-batch variable genes
    "scale_clip",           # dense standardisation
    "nb_residuals",         # count-model residuals
    "pca_project",          # sparse projection
    "knn_join",             # blocked exact kNN
    "knn_graph",
    "roc_auc",              # evaluation
    "label_propagation",    # semi-supervised annotation
    "pca_scores",           # PCA on documents x tokens
    "softmax_predict",      # classifier
    "map_query_knn",        # second-dataset mapping
]
# The reference's full results table (four model fits, incl. the 512-256-128
# MLP) is timed on request only: python bench.py model_comparison


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from countframe.plans.catalog import QUERIES, load_all
    from countframe.session import local_session

    load_all()
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)), driver_memory="16g")
    # warm-up (JVM, codegen) on the smallest tables, not timed
    QUERIES["qc_by_batch"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        if name not in QUERIES:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
