"""Benchmark: time every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...,
 "five_metrics": {"standalone_sum_sec": ..., "staged_report_sec": ...}}

Each query runs to completion through the ``noop`` sink (full execution, no
collection to the driver). One untimed warm-up pass first, then
$BENCH_RUNS timed runs per query; the median is reported.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from churnscope.catalog import QUERIES  # noqa: E402
from churnscope.plans import cohort, report  # noqa: E402
from churnscope.plans.staging import checkpoint_root, ensure_checkpoint_dir, staged_files  # noqa: E402
from churnscope.session import build_session  # noqa: E402
from churnscope.sources.tables import table_reader  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _report(spark, sf_dir: str) -> None:
    """All five metrics through the staged per-person fact table."""
    inputs = cohort.CohortInputs.from_tables(table_reader(spark, sf_dir))
    with staged_files():
        for df in report.cohort_report(inputs, staged=True).values():
            _run(df)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus, app="churnscope-bench")
    # A local run: use the session's checkpoint folder, or a scratch one if none is set.
    if not checkpoint_root(spark):
        ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="churnscope-bench-ckpt-"))
    keys = only or list(QUERIES)

    for k in keys:  # warm-up: JIT, codegen caches, file listing
        _run(QUERIES[k](spark, sf_dir))

    timings = {}
    for k in keys:
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            _run(QUERIES[k](spark, sf_dir))
            samples.append(time.perf_counter() - t0)
        timings[k] = round(statistics.median(samples), 4)

    # The five metrics once more, together: standalone vs one staged fact table.
    standalone = round(sum(timings[k] for k in report.METRIC_KEYS if k in timings), 4)
    _report(spark, sf_dir)  # warm-up
    samples = []
    for _ in range(runs):
        t0 = time.perf_counter()
        _report(spark, sf_dir)
        samples.append(time.perf_counter() - t0)

    print(
        json.dumps(
            {
                "metric": "total_median_sec",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": sf,
                "cpus": cpus,
                "runs": runs,
                "five_metrics": {
                    "standalone_sum_sec": standalone,
                    "staged_report_sec": round(statistics.median(samples), 4),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
