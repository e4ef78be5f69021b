"""Jump consistent hashing against a plain reference."""

import collections
import zlib

import pytest

from ampere.llm import sharding

MASK = (1 << 64) - 1


def jump(key, shards):
    key &= MASK
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) & MASK
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 8, 100])
def test_jump_hash_equals_reference(spark, shards):
    keys = [0, 1, 2, -1, 10**18, -(2**63), 2**63 - 1, *range(50, 300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.s for r in df.select("k", sharding.jump_hash(df["k"], shards).alias("s")).collect()}
    assert got == {k: jump(k, shards) for k in keys}


def test_documents(spark, small, texts):
    rows = sharding.shard_documents(small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = collections.defaultdict(list)
    for r in rows:
        text = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert r.shard == jump(r.doc_id, 8) and r.grown_shard in (r.shard, 8) and r.grown_shard == jump(r.doc_id, 9)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == odd.count()
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert [r.shard for r in rows if r.doc_id is None] == [jump(0, 8)]
    assert sharding.shard_documents(empty).count() == 0


def test_many_copies_of_a_row(spark):
    df = spark.range(5000).selectExpr("7L as doc_id", "'same' as text")
    slots = [r.slot for r in sharding.shard_documents(df).collect()]
    assert sorted(slots) == list(range(5000))


def test_sql_twin(spark):
    from oracle_compare import compare

    from ampere.llm import ORACLES, QUERIES

    r = compare(spark, "op8", QUERIES["op8_jump_shards"], ORACLES["op8_jump_shards"], "/root/testdata/sf0.001")
    assert r["status"] == "match", r
