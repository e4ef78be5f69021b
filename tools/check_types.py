"""Compare the column types of every registered query with its DuckDB SQL."""
import sys
import os
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(sys.path[0], "tests"))
from ampere.session import local_session
from ampere.plans import REGISTRY
from oracle_compare import duck
spark = local_session(8, 8)
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
con = duck(sf)
M = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz",
     "BOOLEAN": "boolean", "TINYINT": "tinyint"}
bad = 0
for n, q in REGISTRY.items():
    if not q.sql:
        continue
    sd = dict(q.run(spark, sf).dtypes)
    rel = con.sql(q.oracle())
    dd = {c: M.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    diff = {c: (sd.get(c), dd.get(c)) for c in set(sd) | set(dd) if sd.get(c) != dd.get(c)}
    if diff:
        bad += 1
        print(n, diff)
print("bad", bad)
