"""Exact search against plain Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampere.llm import ORACLES, QUERIES, topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, every=50, k=5):
    def scaled(v):
        if v is None or any(x is None or not math.isfinite(x * 256) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    kept = [(i, q) for i, v in rows if (q := scaled(v)) is not None]
    out = []
    for n, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            found = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j is None, j or 0) for m, (j, c) in enumerate(kept) if m != n]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def _check(spark, rows, schema=SCHEMA, **kw):
    df = spark.createDataFrame(rows, schema).repartition(3).withColumns({c: F.lit("kept") for c in ("id", "score", "rank", "label", "shard")})
    got = topk.top_k(df, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = brute(rows, **{c: kw[c] for c in ("every", "k") if c in kw})
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    return want


def _clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    v = centres[rng.integers(0, 12, n)] + 0.1 * rng.normal(size=(n, dims))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


@pytest.mark.parametrize("block_rows,shard_bytes", [(1024, 64 << 20), (16, 64 << 20), (7, 4000)])
def test_clusters_in_many_blocks_and_shards(spark, block_rows, shard_bytes):
    rows = [(i - 100, v) for i, v in enumerate(_clustered(700, 8, 1))]
    assert _check(spark, rows, every=10, block_rows=block_rows, shard_bytes=shard_bytes)


def test_ties_copies_and_odd_rows(spark):
    random.seed(3)
    rows = [(i, [random.choice([0.0, 0.5, -0.5]) for _ in range(3)]) for i in range(300)]
    rows += [(50, rows[50][1]), (50, rows[50][1]), (100, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5]), (150, None),
             (200, [None, 0.5, 1.0]), (250, [math.nan, 0.0, 0.0]), (350, [math.inf, 0.0, 0.0]), (400, [1e308, 0.0, 0.0]), (450, []), (500, [1.0]),
             (-50, [0.25, 0.25, 0.25, 9.0])]
    for block_rows in (5, 1024):
        _check(spark, rows, block_rows=block_rows, shard_bytes=3000)
    _check(spark, rows, k=1000)


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = [(i, [0.1, 0.2, 0.3, 0.4] if i % 3 == 0 else v) for i, v in enumerate(_clustered(900, 4, 2))]
    _check(spark, rows, block_rows=32, shard_bytes=8000)
    _check(spark, [(7, [0.5, 0.5])] * 200 + [(50, [0.5, 0.5])] * 200, block_rows=16, shard_bytes=1000)


def test_great_numbers(spark):
    rng = random.Random(4)
    for size in (1e5, 1e6, 1e12, 1e300):
        _check(spark, [(i, [rng.uniform(-size, size) for _ in range(5)]) for i in range(120)], block_rows=16)


def test_few_rows(spark):
    _check(spark, [(0, [1.0])])
    _check(spark, [(0, [1.0]), (1, [2.0])])
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bounds_prune():
    v = np.floor(256 * np.array(_clustered(4096, 16, 5)))
    order = np.lexsort(np.sign(v[:, :6]).T)
    v = v[order]
    blocks = [topk.Block(n, np.arange(at, at + 64), *topk._narrow(v[at : at + 64]), v[at : at + 64].max(axis=0), v[at : at + 64].min(axis=0))
              for n, at in enumerate(range(0, 4096, 64))]
    best = topk.Best(5, np.full(100, -(2**63)), np.full(100, 2**63 - 1))
    scored = topk.search(blocks, v[:100], np.full(100, -1), np.zeros(100, int), best)
    assert scored < 0.35 * 100 * len(blocks)  # blocks of other clusters are never scored


def test_sql_twin(spark):
    from oracle_compare import compare

    r = compare(spark, "op12", QUERIES["op12_block_pruning"], ORACLES["op12_block_pruning"], "/root/testdata/sf0.01")
    assert r["status"] == "match" and r["rows"] == 50, r
