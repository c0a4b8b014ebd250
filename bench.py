"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local threads,
``BENCH_QUERIES`` (comma-separated, or ``all``) the queries. Every result is
computed in full through the noop sink; the second of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scan_project",
    "filter_combined",
    "fk_path_5",
    "join_for_filter",
    "sibling_fanout",
    "order_limit",
    "offset_page",
    "shard",
    "scenario_counts",
    "scenario_results",
    "token_lookup",
    "tod",
    "label_propagate",
    "label_propagate_count_hour",
    "upsert_first",
    "upsert_last",
    "sensor_order",
    "pk_violations",
    "cascade_delete",
    "category_case",
    "remap_labels",
    "points_in_box",
    "fps",
    "prob_normalize",
    "pose_transform",
    "project_points",
    "box_corners",
]


def main() -> None:
    from scenelake.session import local_session
    from workload import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/"))
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
