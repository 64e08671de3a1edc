"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from proofsheet.plans import catalog
from proofsheet.session import session

#: One of each kind: sessions, decisions, metrics, logs, similarity, windows, intervals, signals, text, models, telemetry, sound.
HEADLINE = [
    "burst_peaks", "burst_summary", "fuse_decide", "rubric_stars", "bias_findings", "threshold_grid", "compact_log", "session_conflicts",
    "near_dup_groups", "vector_topk", "face_clusters", "gps_clusters", "tumbling_windows", "sliding_windows", "span_union", "span_subtract", "keyword_band_join", "trim_plan",
    "temporal_scores", "rubric_axes", "sort_modes", "transcript_clauses", "burst_blend", "facet_chains", "telemetry_positions", "sound_frames",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        for _ in range(2):  # the second run counts: code is compiled by then
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
