"""Side-by-side check of registered queries against their DuckDB SQL:
row count, column names and an order-free comparison of values."""

from __future__ import annotations

import datetime as dt
import math
import time

from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark: SparkSession, name: str, build, sql: str | None, sf_dir: str, con=None) -> dict:
    t = time.time()
    sdf = build(spark, sf_dir)
    rows = sdf.collect()
    cols = sdf.columns
    out = {"name": name, "rows": len(rows), "spark_sec": round(time.time() - t, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    out["oracle_rows"] = len(drows)
    if sorted(cols) != sorted(dcols):
        out["status"] = f"columns differ: {sorted(cols)} vs {sorted(dcols)}"
        return out
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in dorder) for r in drows), key=_key)
    if a == b:
        out["status"] = "match"
    else:
        names = sorted(cols)
        bad = {}
        for x, y in zip(a, b):
            if x != y:
                for n, u, v in zip(names, x, y):
                    if u != v:
                        bad.setdefault(n, (u, v))
                if len(bad) > 4:
                    break
        ndiff = sum(x != y for x, y in zip(a, b))
        out["status"] = f"values differ in {ndiff} of {len(a)}/{len(b)} rows, e.g. {bad}"
    return out
