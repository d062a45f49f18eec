"""Summarise the executed plans of every registered query (except the model fits) into PLANS.md.

usage: python scripts/plan_report.py [sf_dir]
Every query runs once into the ``noop`` sink with Spark's event log on (in a new
scratch folder); counts are over the final adaptive plans of all its executions, the
eager steps (checkpoints, small collects) included.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from storelens.plans.catalog import ORACLE, QUERIES  # noqa: E402
from storelens.session import local_session  # noqa: E402

COLUMNS = {"shuffles": r"Exchange$", "broadcasts": r"BroadcastExchange$", "SMJ": r"SortMergeJoin", "BHJ": r"BroadcastHashJoin",
           "windows": r"Window$", "aggregates": r"(Hash|Sort|ObjectHash)Aggregate$", "top-k": r"TakeOrderedAndProject",
           "parquet scans": r"Scan parquet", "checkpoint scans": r"Scan ExistingRDD|RDDScan", "Python": r"Python|Arrow|Pandas"}


def nodes(plan: dict):
    """Node names of a plan; what is reused counts once, where it was made."""
    name = plan["nodeName"].split(" (")[0].strip()
    if name.startswith("ReusedExchange"):
        return
    yield name
    for child in plan["children"]:
        yield from nodes(child)


def counts(folder: str) -> dict[str, Counter]:
    final: dict[int, tuple[str, dict]] = {}
    for entry in os.scandir(folder):
        with open(entry.path, errors="replace") as lines:
            for line in lines:
                if "sparkPlanInfo" not in line:
                    continue
                e = json.loads(line)
                name = e.get("description") or final.get(e["executionId"], ("",))[0]
                final[e["executionId"]] = (name, e["sparkPlanInfo"])
    out: dict[str, Counter] = {}
    for name, plan in final.values():
        found = out.setdefault(name, Counter())
        found["executions"] += 1
        for node in nodes(plan):
            for column, pattern in COLUMNS.items():
                if re.search(pattern, node) and not (column == "shuffles" and node.startswith("Broadcast")):
                    found[column] += 1
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    folder = tempfile.mkdtemp(prefix="storelens-events-")
    spark = local_session(shuffle_partitions=16, conf={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{folder}",
        "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"})
    names = [n for n in QUERIES if not n.startswith("model_selection_")]
    for name in names:
        spark.sparkContext.setJobDescription(name)
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    spark.stop()
    found = counts(folder)
    out = ["# Executed plans", "",
           f"Generated by `scripts/plan_report.py` on `{os.path.basename(sf)}` with 16 shuffle partitions: final adaptive plans of all",
           "executions of a query, its eager steps (checkpoints, small collects) included.  SMJ / BHJ = sort-merge / broadcast",
           "hash joins; `oracle` = DuckDB oracle exists.", "",
           f"| query | oracle | executions | {' | '.join(COLUMNS)} |", f"| --- | --- | --- |{' --- |' * len(COLUMNS)}"]
    for name in names:
        c = found.get(name, Counter())
        out.append(f"| `{name}` | {'yes' if name in ORACLE else 'rows-only'} | {c['executions']} | "
                   + " | ".join(str(c[k]) for k in COLUMNS) + " |")
    out += ["", "Not listed: the model selections, which run thousands of small jobs."]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out) + "\n")


if __name__ == "__main__":
    main()
