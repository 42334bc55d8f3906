"""Physical-plan facts of every registered query -> PLANS.md.

Runs each query (noop sink) with Spark's event log in a scratch folder and
counts the nodes of every final adaptive plan: of the jobs that run while the
query is defined (checkpoints, counts for grid sizes) and of the run itself,
with the seconds of both.  usage: python tools/plan_report.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

KINDS = {
    "shuffles": r"Exchange$",
    "broadcasts": r"BroadcastExchange",
    "reused": r"ReusedExchange",
    "python": r"MapIn|FlatMap.*InPandas|FlatMap.*InArrow|EvalPython",
    "group limits": r"WindowGroupLimit",
    "merge joins": r"SortMergeJoin",
    "hash joins": r"BroadcastHashJoin|ShuffledHashJoin",
    "nested loops": r"NestedLoop|Cartesian",
}


def nodes(plan: dict) -> list[str]:
    name = plan["nodeName"].split(" (")[0].strip()
    return [name, *(x for child in plan["children"] for x in nodes(child))]


def executions(folder: str) -> list[tuple[float, list[str]]]:
    """(start in seconds, node names of the last plan) of every SQL execution."""
    start, last = {}, {}
    for base, _, files in os.walk(folder):
        for name in files:
            with open(os.path.join(base, name), errors="replace") as f:
                for line in f:
                    if "sparkPlanInfo" not in line:
                        continue
                    event = json.loads(line)
                    if "sparkPlanInfo" in event:
                        last[event["executionId"]] = nodes(event["sparkPlanInfo"])
                        if "time" in event:
                            start[event["executionId"]] = event["time"] / 1000
    return [(start[k], last[k]) for k in start]


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=os.path.join(ROOT, "PLANS.md"))
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    log = tempfile.mkdtemp(prefix="passagekit-events-")
    os.environ["PYSPARK_SUBMIT_ARGS"] = (f"--conf spark.eventLog.enabled=true --conf spark.eventLog.dir=file://{log} "
                                         "--conf spark.eventLog.rolling.enabled=false --conf spark.eventLog.compress=false "
                                         "pyspark-shell")
    from passagekit.plans.catalog import CATALOG
    from passagekit.session import get_session
    spark = get_session(shuffle_partitions=8)
    times = []
    for name, fn in CATALOG.items():
        if args.names and name not in args.names:
            continue
        a = time.time()
        df = fn(spark, args.sf)
        b = time.time()
        df.write.format("noop").mode("overwrite").save()
        times.append((name, a, b, time.time()))
        print(name, round(b - a, 2), round(time.time() - b, 2), file=sys.stderr)
    spark.stop()
    found = executions(log)
    with open(args.out, "w") as f:
        f.write("# Physical plans of the registered queries\n\n")
        f.write(f"Nodes of the final adaptive plans at `{args.sf}` on local[8], from Spark's event log "
                "(`tools/plan_report.py`). `define` counts the jobs that run while a query is defined "
                "(checkpoints, sizes of search grids), `run` the query itself; seconds include planning. "
                "`nested loops` must be 0.\n\n")
        f.write("| query | define s | run s | " + " | ".join(f"{k} (define + run)" for k in KINDS) + " |\n")
        f.write("| --- | --- | --- | " + " | ".join("---" for _ in KINDS) + " |\n")
        for name, a, b, c in times:
            cells = []
            for pattern in KINDS.values():
                count = [sum(bool(re.search(pattern, x)) for t, plan in found if lo <= t < hi for x in plan)
                         for lo, hi in ((a, b), (b, c))]
                cells.append(f"{count[0]} + {count[1]}" if count[0] else str(count[1]))
            f.write(f"| {name} | {b - a:.1f} | {c - b:.1f} | " + " | ".join(cells) + " |\n")


if __name__ == "__main__":
    main()
