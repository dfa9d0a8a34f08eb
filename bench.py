"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import signal
import sys
import time

from framelake.queries import QUERIES
from framelake.session import build_session

HEADLINE = [
    "id_activity",
    "byte_activity",
    "period_stats",
    "change_rate",
    "decode_registry",
    "decode_hv_frames",
    "window_correlation",
    "bit_event_candidates",
    "nearest_within",
    "signal_speed_correlation",
    "state_runs",
    "cadence_stats",
    "precharge_report",
    "isotp_reassembly",
    "diag_events",
    "pair_transactions",
    "asof_definition",
    "did_fifo",
    "live_pairs",
    "trace_validation",
    "band_match",
    "marker_nearest",
    "series_pair_score",
    "c5_load",
    "dbc_load",
    "sim_reference_map",
    "frame_rate_1s",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    seconds: dict[str, float] = {}

    def report() -> None:
        print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}), flush=True)

    def stopped(*_: object) -> None:
        report()  # what has ended by then
        os._exit(1)

    signal.signal(signal.SIGTERM, stopped)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    report()


if __name__ == "__main__":
    main()
