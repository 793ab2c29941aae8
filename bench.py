"""Headline queries, timed end to end; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--detail]
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowgauge.catalog import QUERIES, load_all  # noqa: E402
from flowgauge.session import local_session  # noqa: E402

# Whole tables, whole results: each query is run to a no-op sink.
HEADLINE = [
    "p1_drop_invalid",
    "p3_deduplicate",
    "p4_clean_report",
    "e2_standard_scale",
    "e4_preprocess",
    "t1_stratified_split",
    "t2_ten_seed_splits",
    "r1_keyed_rank",
    "t9_rank_bins",
    "c8_nearest_centroid",
    "j1b_assign_flows",
    "m1_diversity_exact",
    "m1b_diversity_features",
    "m2_ks_greater",
    "m4_gini",
    "m6b_assessment_flows",
    "m6d_full_assessment_with_diversity",
    "m9_macro_metrics",
    "m11_spearman",
    "x2b_ranked_subsets_flows",
    "x5_dataset_comparison",
    "a2_perturbed_rows",
    "a4_candidate_scores",
    "a5_transitions",
    "a8b_policy_selection",
    "c1_kmeans_sweep",
    "w1_continuous_assessment",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cpus, "flowgauge-bench")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        if "--detail" in sys.argv:
            print(f"{name:40s} {seconds[name]:8.2f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
