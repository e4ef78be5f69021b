"""Physical-plan summary of every registered query: exchanges by kind,
single-partition exchanges (and what feeds them), broadcasts, and whether
the parquet scans prune columns / push filters.

usage: python tools/plan_report.py [sf_dir] [name ...]
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ampere.plans import REGISTRY  # noqa: E402
from ampere.session import local_session  # noqa: E402


def summarize(plan: str) -> dict:
    lines = plan.split("\n")
    out = {"hash": 0, "range": 0, "single": 0, "broadcast": 0, "single_feeds": set(), "scans": []}
    for i, l in enumerate(lines):
        if "Exchange hashpartitioning" in l:
            out["hash"] += 1
        elif "Exchange rangepartitioning" in l:
            out["range"] += 1
        elif "Exchange SinglePartition" in l:
            out["single"] += 1
            # the operator right below tells what is gathered
            below = next((x.strip() for x in lines[i + 1:i + 3] if x.strip()), "")
            out["single_feeds"].add(re.sub(r"[#(\[].*", "", below.lstrip("+-: *")).strip())
        elif "BroadcastExchange" in l:
            out["broadcast"] += 1
        if "FileScan parquet" in l:
            rs = re.search(r"ReadSchema: struct<([^>]*)>", l)
            pf = re.search(r"PushedFilters: \[([^\]]*)\]", l)
            out["scans"].append((len(rs.group(1).split(",")) if rs else None, bool(pf and pf.group(1))))
    return out


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or [n for n in REGISTRY if not n.startswith("model_")]
    spark = local_session(8)
    for n in names:
        df = REGISTRY[n].run(spark, sf_dir)
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        feeds = ",".join(sorted(s["single_feeds"])) or "-"
        print(f"{n:34s} hash={s['hash']:<2d} range={s['range']:<2d} single={s['single']:<2d} "
              f"bcast={s['broadcast']:<2d} single<-[{feeds}] scans(cols,pushed)={s['scans']}")


if __name__ == "__main__":
    main()
