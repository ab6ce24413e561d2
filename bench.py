"""Times the headline queries and prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from visorlake.plans.registry import all_queries
from visorlake.session import local_session

HEADLINE = [
    "e1_leakage_free_dataset", "e2_status_of_clips", "p02_box_from_xywh_px", "p09_pairwise_distance_features", "p20_phash",
    "f02_filter_first_person", "f04_filter_candidates", "j01_attach_images_left", "j07_near_duplicate_pairs", "j07_strict_pairs",
    "j09_best_match", "j12_temporal_support", "j15_latest_event_asof", "a01_dataset_stats", "a04_annotator_leaderboard", "a05_project_progress",
    "a18_detection_metrics", "w01_cap_per_group", "w03_stride_sample", "w07_dedup_consecutive", "w12_running_count", "w14_ema",
    "g04_merge_hand_over_auto", "c01_cluster_duplicates", "c03_split_by_entity", "c05_select_for_review", "c06_nms", "c08_build_tracks",
    "c13_detect_hits_ego", "c14_detect_hits_boxonly", "t05_stream_leaderboard", "u01_predict", "s01_k01_yolo_labels",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    queries["u01_predict"](spark, folder).write.format("noop").mode("overwrite").save()       # start the workers
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
