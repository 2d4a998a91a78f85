"""Write PLANS.md: a digest of the physical plan of every registered query.

Two views per query:

* scale: the final plan when run with file-size estimates inflated 1000x
  (``spark.sql.sources.fileCompressionFactor``) and AQE's runtime
  broadcast threshold at 64 KB: fact tables and everything derived from
  them plan as large (sort-merge joins), only the dimension file and
  results of a few rows (the role map) are broadcast, as at 100 TB;
* sf0.1: the final adaptive plan after running at sf0.1 (AQE has replaced
  joins against small measured sides by broadcasts).

Usage: python tools/plan_digest.py [data_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from churnscope.catalog import QUERIES  # noqa: E402
from churnscope.session import build_session  # noqa: E402


def digest(plan: str) -> dict:
    if "== Final Plan ==" in plan:
        plan = plan.split("== Initial Plan ==")[0]
    lines = plan.splitlines()

    def count(pat: str) -> int:
        return sum(1 for line in lines if re.search(pat, line))

    scans = []
    for line in lines:
        m = re.search(r"FileScan parquet \[([^\]]*)\].*?Location: \w+\(1 paths\)\[[^\]]*/(\w+)\.parquet\]", line)
        if m:
            scans.append(f"{m.group(2)}({len(m.group(1).split(','))})")
    return {
        "hash": count(r"Exchange hashpartitioning"),
        "range": count(r"Exchange rangepartitioning"),
        "bcast": count(r"BroadcastExchange"),
        "reused": count(r"ReusedExchange"),
        "smj": count(r"SortMergeJoin"),
        "bhj": count(r"BroadcastHashJoin"),
        "bnlj": count(r"BroadcastNestedLoopJoin|CartesianProduct"),
        "top1": count(r"WindowGroupLimit.*Partial"),
        "python": count(r"EvalPython|PythonUDF|FlatMapGroupsInPandas|MapInPandas"),
        "scans": " ".join(sorted(scans)),
    }


def main() -> None:
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    rows = []
    scale_conf = {
        "spark.sql.sources.fileCompressionFactor": "1000",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64k",
    }
    for key, fn in QUERIES.items():
        for k, v in scale_conf.items():
            spark.conf.set(k, v)
        df = fn(spark, root)
        df.collect()
        static = digest(df._jdf.queryExecution().executedPlan().toString())
        for k in scale_conf:
            spark.conf.unset(k)
        df = fn(spark, root)
        df.collect()
        final = digest(df._jdf.queryExecution().executedPlan().toString())
        rows.append((key, static, final))

    print("# PLANS\n")
    print(__doc__.split("Usage:")[0].strip().replace("Write PLANS.md: a", "A"))
    print(
        "\nColumns: shuffle exchanges (hash / range), broadcast exchanges, reused exchanges, "
        "sort-merge / broadcast-hash joins, nested-loop or Cartesian joins, partial top-1 "
        "(WindowGroupLimit before a shuffle), Python evaluation nodes, and the parquet scans "
        "with the number of columns each reads. Generated by `tools/plan_digest.py`.\n"
    )
    print("| query | scale: shuffles h/r | bcast | reused | SMJ/BHJ | sf0.1: shuffles h/r | bcast | reused | "
          "SMJ/BHJ | top-1 partial | NLJ | python | scans (columns read) |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for key, s, f in rows:
        print(
            f"| {key} | {s['hash']}/{s['range']} | {s['bcast']} | {s['reused']} | {s['smj']}/{s['bhj']} | "
            f"{f['hash']}/{f['range']} | {f['bcast']} | {f['reused']} | {f['smj']}/{f['bhj']} | "
            f"{f['top1']} | {f['bnlj']} | {f['python']} | {f['scans']} |"
        )
    spark.stop()


if __name__ == "__main__":
    main()
