"""Stable sharding by jump consistent hashing, with DataFrame functions only.

Jump consistent hashing (Lamping and Veach, 2014) runs a linear congruential
generator seeded by the key and jumps ahead through bucket numbers; the last
jump below the shard count is the shard. There is no ring table, and when the
count grows from n to n + 1 a key either stays or moves into shard n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# the published generator: 64-bit multiplier, and the modulus 2^64
_MULTIPLIER = "2862933555777941757"
_MODULUS = "18446744073709551616"


def jump_hash(key: Column, shards: int) -> Column:
    """Shard (int, 0 to ``shards`` - 1) of a bigint key; a null key counts as 0.

    The 64-bit wrap-around arithmetic is done in exact decimals, since ANSI
    bigint products raise on overflow. The jumps strictly increase, so
    ``shards`` steps always reach the end.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    number = lambda s: F.expr(f"cast({s} as decimal(20, 0))")
    state = ((F.coalesce(key, F.lit(0)).cast("decimal(20,0)") + number(_MODULUS)) % number(_MODULUS)).cast("decimal(20,0)")

    def step(acc: Column, _: Column) -> Column:
        state = ((acc["state"] * number(_MULTIPLIER) + number("1")) % number(_MODULUS)).cast("decimal(20,0)")
        high = F.floor(state / F.expr("cast(8589934592 as decimal(10, 0))")).cast("double")
        ahead = F.floor((acc["ahead"].cast("double") + 1.0) * (F.lit(float(2**31)) / (high + 1.0))).cast("bigint")
        moved = F.struct(state.alias("state"), acc["ahead"].alias("shard"), ahead.alias("ahead"))
        return F.when(acc["ahead"] < shards, moved).otherwise(acc)

    start = F.struct(state.alias("state"), F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("ahead"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["shard"].cast("int"))


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``df`` with ``shard`` among ``shards`` and ``grown_shard`` among one
    more. A projection: no shuffle, any extra columns pass, equal keys share a
    shard. Columns named ``shard`` or ``grown_shard`` are replaced."""
    return df.withColumns({"shard": jump_hash(F.col(key), shards), "grown_shard": jump_hash(F.col(key), shards + 1)})


def slot_bucket(key: Column, crc: Column) -> Column:
    """One of 4096 buckets (int) by the key and the text's checksum: the top
    bits of key x multiplier + checksum x 2^32, modulo 2^64."""
    number = lambda s: F.expr(f"cast({s} as decimal(20, 0))")
    unsigned = ((F.coalesce(key, F.lit(0)).cast("decimal(20,0)") + number(_MODULUS)) % number(_MODULUS)).cast("decimal(20,0)")
    mixed = (unsigned * number(_MULTIPLIER) + crc.cast("decimal(20,0)") * number("4294967296")) % number(_MODULUS)
    return F.floor(mixed.cast("decimal(20,0)") / F.expr("cast(4503599627370496 as decimal(16, 0))")).cast("int")


def number_slots(df: DataFrame, order_by: list[str], bucket: Column) -> DataFrame:
    """Add ``slot``: 0, 1, 2 ... without gaps within each ``shard``, in the
    order of ``bucket`` and then ``order_by``.

    A shard may hold any share of the rows, so no window spans one: equal rows
    are counted first (map-side), a row's slot is its bucket's start (running
    sum over one count per bucket) plus its place in the bucket. Equal rows
    take consecutive slots.
    """
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_copies")).withColumn("_bucket", bucket)
    sums = rows.groupBy("shard", "_bucket").agg(F.sum("_copies").alias("_n"))
    before = F.sum("_n").over(_window(["shard"], ["_bucket"]))
    starts = sums.select("shard", "_bucket", (before - F.col("_n")).alias("_start"))
    first = F.sum("_copies").over(_window(["shard", "_bucket"], order_by)) - F.col("_copies")
    placed = rows.withColumn("_first", first).join(starts, ["shard", "_bucket"])
    # copies in two steps, so that no array grows with the number of copies
    thousand = F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("_copies") - 1).cast("bigint"), F.lit(1000).cast("bigint")))
    placed = placed.withColumn("_from", thousand)
    one = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + 999, F.col("_copies") - 1)))
    placed = placed.withColumn("_copy", one)
    return placed.select(*df.columns, (F.col("_start") + F.col("_first") + F.col("_copy")).alias("slot"))


def _window(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size``: UTF-8 bytes of the text plus 1 (null text: 1). Law ``key``: the
    shard depends on ``doc_id`` and the shard count alone; null ids count as
    key 0. Repeated rows stay repeated, each with a slot of its own. An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    bucket = slot_bucket(F.col("doc_id"), F.col("text_crc32"))
    slots = number_slots(assign_shards(rows, "doc_id", shards), ["doc_id", "size", "text_crc32"], bucket)
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: DuckDB twin of ``shard_documents(documents)``
ORACLE_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT id, CAST((CAST(id AS HUGEINT) + {_MODULUS}) % {_MODULUS} AS HUGEINT) AS state, CAST(0 AS BIGINT) AS j
  FROM (SELECT DISTINCT COALESCE(doc_id, 0) AS id FROM documents) k
  UNION ALL
  SELECT id, s, CAST(FLOOR((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST((s >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT id, j, (state * {_MULTIPLIER} + 1) % {_MODULUS} AS s FROM steps WHERE j < 9) x),
shards AS (
  SELECT id, CAST(MAX(j) FILTER (WHERE j < 8) AS INTEGER) AS shard, CAST(MAX(j) FILTER (WHERE j < 9) AS INTEGER) AS grown_shard
  FROM steps GROUP BY id),
-- CRC-32 by its table: eight shift steps for each byte value
crc AS (
  SELECT list(v ORDER BY b) AS tab FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256)) r) t),
docs AS (
  SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents) d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY
    ((CAST((CAST(id AS HUGEINT) + {_MODULUS}) % {_MODULUS} AS HUGEINT) * {_MULTIPLIER} + CAST(text_crc32 AS HUGEINT) * 4294967296) % {_MODULUS}) >> 52,
    doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM docs JOIN shards ON id = COALESCE(doc_id, 0)"""
