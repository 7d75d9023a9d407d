"""Time the headline queries and print one JSON line.

BENCH_SF_DIR chooses the data, BENCH_CPUS the local cores, BENCH_QUERIES (comma list of
names) a subset, BENCH_QUERIES=all every registered query. Each query runs BENCH_RUNS times (3) in a
row; its time is the median, so that what ran before it matters less. Building the plan counts, as some
operators read small facts then.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumentrace.catalog import load  # noqa: E402
from lumentrace.session import build_session  # noqa: E402

HEADLINE = [
    "g3_dff",
    "g4_ratio",
    "g6_composite_signal",
    "i12_roi_traces",
    "i12_roi_traces_lineitem",
    "c22_rise",
    "c35_peak_after_onset",
    "c330_median_all",
    "c_chunk_magnitude",
    "c_delay_rising_phase",
    "r2_mean_filter",
    "r3_median_filter",
    "r5_gaussian_space",
    "r6_gaussian_time",
    "r7_scattered_light",
    "r12_bleach_pixelwise",
    "r13_bleach_uniform",
    "r17_motion_estimate",
    "r20_binning",
    "r27_correction_pipeline",
    "t3_resolve_times",
    "t6_active_stimuli",
    "m15_append_list",
    "m29_first_existing_path",
    "m31_unique_labels",
    "h1_full_trace_table",
    "h2_chunk_table",
    "o2_feature_by_stimulus",
    "o5_limits_percentile_movie",
    "o16_movie_filtered",
    "o16_movie_table",
    "o19_tapestry_plan",
    "o24_scale_codes",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load()
    names = os.environ.get("BENCH_QUERIES", "")
    chosen = list(queries) if names == "all" else names.split(",") if names else HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        app="lumentrace-bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times: dict[str, float] = {}
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    for name in chosen:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": f"headline queries, total of the median wall times of {runs} runs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf)),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
