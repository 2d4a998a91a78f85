"""Where the time of a registered query goes, from Spark's event log.

Usage: python tools/stage_times.py [data_dir] [key ...]

Runs each query once to warm up and once measured (``noop`` sink) with the
event log written to a new scratch folder, then prints per query: wall
time, driver-side plan construction, number of jobs and stages, summed task
time and shuffle records / bytes written.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from churnscope.catalog import QUERIES  # noqa: E402
from churnscope.session import build_session  # noqa: E402


def _events(root: str):
    for path in sorted(glob.glob(os.path.join(root, "*", "events_*"))):
        raw = open(path, "rb").read()
        if path.endswith(".zstd"):
            import zstandard

            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode().splitlines():
            if line.strip():
                yield json.loads(line)


def main() -> None:
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    keys = sys.argv[2:] or list(QUERIES)
    log_dir = tempfile.mkdtemp(prefix="churnscope-events-")
    spark = build_session(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    sc = spark.sparkContext
    wall, build = {}, {}
    for key in keys:
        sc.setJobGroup("warm-up", "warm-up")
        QUERIES[key](spark, root).write.format("noop").mode("overwrite").save()
        sc.setJobGroup(key, key)
        t0 = time.perf_counter()
        df = QUERIES[key](spark, root)
        t1 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        wall[key], build[key] = time.perf_counter() - t0, t1 - t0
    spark.stop()

    stage_group, jobs = {}, defaultdict(int)
    task_ms = defaultdict(int)
    records, written = defaultdict(int), defaultdict(int)
    stages = defaultdict(set)
    for e in _events(log_dir):
        kind = e.get("Event")
        if kind == "SparkListenerJobStart":
            group = (e.get("Properties") or {}).get("spark.jobGroup.id")
            if group in wall:
                jobs[group] += 1
                for s in e.get("Stage IDs", []):
                    stage_group[s] = group
        elif kind == "SparkListenerTaskEnd" and e["Stage ID"] in stage_group:
            g = stage_group[e["Stage ID"]]
            info, m = e.get("Task Info", {}), e.get("Task Metrics") or {}
            task_ms[g] += info.get("Finish Time", 0) - info.get("Launch Time", 0)
            w = m.get("Shuffle Write Metrics", {})
            records[g] += w.get("Shuffle Records Written", 0)
            written[g] += w.get("Shuffle Bytes Written", 0)
            stages[g].add(e["Stage ID"])

    print(f"{'query':28s} {'wall s':>7s} {'build s':>7s} {'jobs':>5s} {'stages':>6s} "
          f"{'task s':>7s} {'shuffle rows':>12s} {'shuffle KB':>10s}")
    for key in keys:
        print(f"{key:28s} {wall[key]:7.2f} {build[key]:7.2f} {jobs[key]:5d} {len(stages[key]):6d} "
              f"{task_ms[key] / 1000:7.2f} {records[key]:12d} {written[key] / 1024:10.1f}")
    print(f"(event log: {log_dir})")


if __name__ == "__main__":
    main()
