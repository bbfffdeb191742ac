"""Print the physical plan shape of registered queries (operator tree + scan pushdown).

Usage: python tools/plans.py [--sf DIR] [name ...] > docs/PLANS.md
The plan is taken after execution so AQE's final choices (broadcasts, coalescing) show.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shape(plan: str) -> str:
    keep = []
    for line in plan.splitlines():
        if not line.strip() or line.strip().startswith("("):
            continue
        m = re.match(r"^([\s:+\-|]*)([A-Za-z][A-Za-z]*)", line)
        if m:
            keep.append(f"{m.group(1)}{m.group(2)}")
    return "\n".join(keep)


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from bench import HEADLINE
    from tidemark.plans.registry import QUERIES, load_all
    from tidemark.session import local_session

    load_all()
    spark = local_session(shuffle_partitions=16)
    print(f"# Physical plans (final AQE plans at {os.path.basename(a.sf)}, local[*], 16 shuffle partitions)\n")
    for n in a.names or HEADLINE:
        df = QUERIES[n](spark, a.sf)
        df.write.format("noop").mode("overwrite").save()
        qe = df._jdf.queryExecution()
        plan = qe.executedPlan().toString()
        fmt = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", fmt)) - {""})
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", fmt)))
        print(f"## {n}\n")
        print(f"exchanges: {plan.count('Exchange hashpartitioning') + plan.count('Exchange rangepartitioning') + plan.count('Exchange SinglePartition')}, "
              f"broadcasts: {plan.count('BroadcastExchange')}, reused: {plan.count('Reused')}\n")
        print("```\n" + shape(plan) + "\n```\n")
        if pushed:
            print("pushed filters: " + "; ".join(pushed[:6]) + "\n")
        if schemas:
            print("read schemas: " + "; ".join(s[:160] for s in schemas[:6]) + "\n")


if __name__ == "__main__":
    main()
