"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from orfloom import local_session, plans

HEADLINE = [
    "J02_status_counts_after_mapping",
    "J09_gap_table",
    "A03_cluster_stats",
    "A16_macro_f1",
    "A17_confusion",
    "A22_weighted_mean_vector",
    "A28_neighbor_mean",
    "F09_windows",
    "W01_context_features",
    "W01_context_features_short_groups",
    "W02_context_graph",
    "W03_row_index",
    "W04_canonical_hit",
    "W07_shards",
    "M01_split_counts",
    "M03_exact_dedup",
    "M04_near_duplicate_clusters",
    "M05_sampling_probability",
    "M05_balanced_draws",
    "M07_task_routing",
    "M10_multimodal_pack",
    "M15_vectorize",
    "M18_evaluation_bundle",
    "U05_leakage",
    "X05_open_set_scores",
    "X08_prototype_distance",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    plans.load()
    spark = local_session(cpus, "orfloom-bench", os.environ.get("BENCH_MEMORY", "16g"))
    plans.QUERIES["A01_value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
