"""Run registered queries against their DuckDB SQL at one scale.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(sys.path[0], "tests"))

from ampere.plans import REGISTRY  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402
from ampere.session import local_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or list(REGISTRY)
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        q = REGISTRY[n]
        try:
            r = compare(spark, n, q.run, q.oracle(), sf_dir, con)
        except Exception as e:  # report and go on
            r = {"name": n, "status": f"error: {type(e).__name__}: {str(e)[:400]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
