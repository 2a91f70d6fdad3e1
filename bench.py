"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callweave.plans import registry  # noqa: E402
from callweave.session import INPUT_PARTITIONS, local_session  # noqa: E402

HEADLINE = [
    "worst_calls_and_why",
    "jn1_word_alignment",
    "wn1_merge_adjacent",
    "so1_all_violations",
    "ag3_compliance_totals",
    "fx1_fusion",
    "fx7_acoustic_emotion",
    "ag12_document_summary",
    "ag12_call_summary",
    "ag18_prosody",
    "ag14_snr_by_silence",
    "ag19_silhouette_confidence",
    "ag20_rolling_separability",
    "ag22_boundary_features",
    "ud3_frame_features",
    "jn12_timeline",
    "io9_store_lookup",
    "st1_job_progress",
    "st4_stage_latency",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    picks = os.environ.get("BENCH_QUERIES", "")
    registry.load()
    # The tables are single files of one row group.
    spark = local_session(cores, **{INPUT_PARTITIONS: cores})
    names = [n for n in (picks.split(",") if picks else HEADLINE) if n in registry.QUERIES]
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    times: dict[str, float] = {}
    registry.QUERIES["io6_latest_result"](spark, folder).count()  # start workers and compile once
    for name in names:
        best = None
        for _ in range(runs):
            begin = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begin
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
