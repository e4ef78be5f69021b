"""Exact inner-product search by block-at-a-time pruning.

Rows are laid out in ranges of similar vectors and cut into blocks; a block's
forward index is the matrix of its rows, and the greatest and least value of
each component over its rows bound every inner product with them. A query
orders the blocks by that bound (the summed maxima of its terms), scores them
through their forward indexes from the highest bound on and stops where the
bound falls below its k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampere.llm.packing import hilbert_keys
from ampere.llm.tables import seeds64, staged

_SCALE = 256
#: stands for a null id in the search: after all others
_NO_ID = 2**63 - 1
_LEAST = -(2**63)
#: shards per row of the table of shard bounds, and queries of a batch
_PIECE, _BATCH = 1024, 256


def quantised(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """``(matrix, whole)``: floor(256 x) of each component as doubles, missing
    ones zero, and which rows take part (no null, nothing that isn't finite,
    the scaled values included)."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0)).astype(np.int64)
    flat = np.asarray(pc.fill_null(vectors.flatten().cast(pa.float64()), np.nan), np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(_SCALE * flat)
    bad = ~np.isfinite(scaled)
    whole = np.asarray(pc.is_valid(vectors)) & (np.bincount(row[bad], minlength=len(sizes)) == 0)
    matrix = np.zeros((len(sizes), dims))
    matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(bad, 0, scaled)
    return matrix, whole


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products (long) of the rows of two matrices of whole
    numbers; those beyond a long become the nearest one."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([int(x) for x in m.ravel()], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, _LEAST, _NO_ID).astype(np.int64)


def _narrow(matrix: np.ndarray) -> tuple[str, bytes]:
    """The matrix in the narrowest type that holds it, and the type."""
    most = np.abs(matrix).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, matrix.astype(kind).tobytes()


def _wide(kind: str, data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dims).astype(np.float64)


class Best:
    """The ``k`` best (score, then least id) of each of some queries, and the
    (score, id) that the next must reach: the k-th best known so far."""

    def __init__(self, k: int, score: np.ndarray, ids: np.ndarray):
        self._k = k
        self.bar, self.bar_id = score.copy(), ids.copy()
        self._found = [np.zeros(0, np.int64)] * 3  # query, score, id

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Candidates: one row of ``scores`` per query, one column per id;
        ``own`` is the column of a query's own row, or -1."""
        bar = self.bar[queries, None]
        hit = (scores > bar) | (scores == bar) & (ids <= self.bar_id[queries, None])
        hit[np.flatnonzero(own >= 0), own[own >= 0]] = False
        r, c = np.nonzero(hit)
        if len(r) == 0:
            return
        query = np.concatenate((self._found[0], queries[r]))
        score = np.concatenate((self._found[1], scores[r, c]))
        found = np.concatenate((self._found[2], ids[c]))
        order = np.lexsort((found, ~score, query))  # ~x falls where x rises, at every long
        query, score, found = query[order], score[order], found[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self._k
        self._found = [query[kept], score[kept], found[kept]]
        last = place == self._k - 1
        better = (score[last] > self.bar[query[last]]) | (score[last] == self.bar[query[last]]) & (found[last] < self.bar_id[query[last]])
        at = query[last][better]
        self.bar[at], self.bar_id[at] = score[last][better], found[last][better]

    def found(self) -> list[np.ndarray]:
        return self._found


@dataclass
class Block:
    """Rows of one range: ids, forward index, component maxima and minima."""

    uid: int
    ids: np.ndarray
    kind: str
    data: bytes
    high: np.ndarray
    low: np.ndarray


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Greatest inner product (queries x blocks) that component ranges allow."""
    return dot(np.hstack((np.maximum(queries, 0), np.minimum(queries, 0))), np.hstack((high, low)))


def search(blocks: list[Block], queries: np.ndarray, own_block: np.ndarray, own_place: np.ndarray, best: Best) -> int:
    """Score the queries through ``blocks``, each in the order of its bounds,
    until the bound falls below its k-th best. Returns how many pairs of query
    and block were scored."""
    if not blocks or len(queries) == 0:
        return 0
    dims = queries.shape[1]
    limit = bounds(queries, np.stack([b.high for b in blocks]), np.stack([b.low for b in blocks]))
    least_id = np.array([b.ids.min() for b in blocks])
    order = np.argsort(~limit, axis=1, kind="stable")
    live, scored = np.arange(len(queries)), 0
    for place in range(len(blocks)):
        block = order[live, place]
        top = limit[live, block]
        going = top >= best.bar[live]
        live, block, top = live[going], block[going], top[going]
        if len(live) == 0:
            break
        wanted = (top > best.bar[live]) | (least_id[block] <= best.bar_id[live])
        for number in np.unique(block[wanted]):
            b = blocks[number]
            who = live[wanted & (block == number)]
            scores = dot(queries[who], _wide(b.kind, b.data, dims))
            best.add(who, scores, b.ids, np.where(own_block[who] == b.uid, own_place[who], -1))
            scored += len(who)
    return scored


_BLOCKS = ("uid long, shard int, ids binary, kind string, data binary, high binary, low binary, "
           "own_place binary, q_kind string, q_data binary, bar binary, bar_id binary")
_TASKS = "shard int, part int, batch boolean, " + _BLOCKS.replace("shard int, ", "").replace("own_place binary", "own_block binary, own_place binary")


def _long(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _rows(out: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(zip(*out), kinds)], list(names))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_column: str = "vec_id", column: str = "embedding",
          block_rows: int = 1024, shard_bytes: int = 64 << 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the highest
    integer inner products for each row whose id is divisible by ``every``,
    among all rows but itself; ties go to the smaller id.

    Vectors that are null or hold a null or a component that isn't finite
    (scaled by 256 too) take no part; a shorter vector is padded by zeros. Rows
    with a null id are candidates, after all ids in ties, never queries.
    Repeated rows are candidates each, of each other too, and queries each. A
    query with fewer candidates gets all, one without any gets no row.
    Scores beyond a long become the nearest one. An empty table gives no rows.

    Jobs run while the plan is built. Rows are range-sorted along a curve
    through projected vectors (copies by id and place, so that a large group
    of them spans ranges) and written as blocks. A query first scores its own
    block; only queries whose k-th score a shard's bound reaches are sent to
    the shard, in batches. A task holds one shard of at most about
    ``shard_bytes``.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("vector"))
    size = source.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    dims = max(1, size.dims or 0)
    shards = max(1, -(-size.n * dims * 8 // shard_bytes))
    spread = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // shards), -(-size.n // shards // block_rows)))

    def laid_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 40
        directions = seeds64(dims * 3, 11).reshape(dims, 3) / 2.0**63 - 1.0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                matrix, whole = quantised(part.column("vector"), dims)
                matrix = matrix[whole]
                norm = np.linalg.norm(matrix / _SCALE, axis=1, keepdims=True)
                curve = hilbert_keys(matrix / _SCALE / np.where(norm == 0, 1, norm) @ directions, 1.5)
                ids = part.column("id").filter(pa.array(whole))
                values = [r.tobytes() for r in matrix]
                asks = pc.fill_null(pc.equal(pc.subtract(ids, pc.multiply(pc.divide(ids, every), every)), 0), False)
                yield pa.RecordBatch.from_arrays(
                    [ids.fill_null(_NO_ID), pa.array(range(place, place + len(values)), pa.int64()), pa.array(curve), asks,
                     pa.array(values, pa.binary())], ["id", "place", "curve", "asks", "vector"])
                place += len(values)

    rows = source.mapInArrow(laid_out, "id long, place long, curve long, asks boolean, vector binary")
    rows = rows.repartitionByRange(shards * spread, "curve", "id", "place").sortWithinPartitions("curve", "id", "place")

    def built(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        uid, held, n = part << 32, [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            ids = np.asarray(table.column("id"))
            matrix = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(-1, dims)
            places = np.flatnonzero(np.asarray(table.column("asks")))
            best = Best(k, np.full(len(places), _LEAST), np.full(len(places), _NO_ID))
            high, low = matrix.max(axis=0), matrix.min(axis=0)
            own = Block(uid, ids, *_narrow(matrix), high, low)
            search([own], matrix[places], np.full(len(places), uid), places, best)
            return _rows([(uid, part // spread, ids.tobytes(), own.kind, own.data, high.tobytes(), low.tobytes(), places.tobytes(),
                           *_narrow(matrix[places]), best.bar.tobytes(), best.bar_id.tobytes())], _BLOCKS)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block_rows:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, block_rows))
                held, n, uid = table.slice(block_rows).to_batches(), n - block_rows, uid + 1
        if n:
            yield block(pa.Table.from_batches(held))

    blocks = staged(rows.select("id", "asks", "vector").mapInArrow(built, _BLOCKS), "topk-blocks")

    def bounded(rows: pd.DataFrame) -> pd.DataFrame:
        wide = lambda c: np.stack([np.frombuffer(x) for x in rows[c]])
        return pd.DataFrame({"shard": rows["shard"][:1], "high": [wide("high").max(axis=0).tobytes()], "low": [wide("low").min(axis=0).tobytes()]})

    pieces = (blocks.select("shard", "high", "low").groupBy("shard").applyInPandas(bounded, "shard int, high binary, low binary")
              .groupBy(F.floor(F.col("shard") / _PIECE).cast("int").alias("piece"))
              .agg(F.collect_list(F.struct("shard", "high", "low")).alias("shards")))

    def batched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def batch() -> pa.RecordBatch:
            first = held[0]
            joined = [np.concatenate(x).tobytes() for x in zip(*(h[1:] for h in held))]
            kind, data = _narrow(np.concatenate([h[0] for h in held]))
            return _rows([(first[2][0], *joined, kind, data)],
                         "uid long, ids binary, own_block binary, own_place binary, bar binary, bar_id binary, q_kind string, q_data binary")

        for b in batches:
            for r in b.to_pylist():
                places = _long(r["own_place"])
                held.append((_wide(r["q_kind"], r["q_data"], dims), _long(r["ids"])[places], np.full(len(places), r["uid"]), places,
                             _long(r["bar"]), _long(r["bar_id"])))
                n += len(places)
                if n >= _BATCH:
                    yield batch()
                    held, n = [], 0
        if held:
            yield batch()

    asked = blocks.where(F.length("own_place") > 0).select("uid", "ids", "own_place", "q_kind", "q_data", "bar", "bar_id")
    asked = asked.mapInArrow(batched, "uid long, ids binary, own_block binary, own_place binary, bar binary, bar_id binary, "
                                      "q_kind string, q_data binary")
    last_piece = (shards - 1) // _PIECE
    asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(last_piece)))).join(pieces, "piece")

    def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                queries, bar = _wide(r["q_kind"], r["q_data"], dims), _long(r["bar"])
                wide = lambda c: np.stack([np.frombuffer(s[c]) for s in r["shards"]])  # noqa: B023, E731
                reach = bounds(queries, wide("high"), wide("low")) >= bar[:, None]
                for number, s in enumerate(r["shards"]):
                    who = np.flatnonzero(reach[:, number])
                    if len(who):
                        kind, data = _narrow(queries[who])
                        yield _rows([(s["shard"], r["uid"] % 1000003 % spread, True, r["uid"], _long(r["ids"])[who].tobytes(), "", b"", b"", b"",
                                      _long(r["own_block"])[who].tobytes(), _long(r["own_place"])[who].tobytes(), kind, data,
                                      bar[who].tobytes(), _long(r["bar_id"])[who].tobytes())], _TASKS)

    names = [f.split()[0] for f in _TASKS.split(", ")]
    scanned = (blocks.select("uid", "shard", "ids", "kind", "data", "high", "low")
               .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("batch", F.lit(False))
               .withColumns({c: F.lit(None).cast("string" if c == "q_kind" else "binary") for c in names if c.startswith(("own_", "q_", "bar"))}))
    tasks = scanned.select(*names).unionAll(asked.mapInArrow(routed, _TASKS).select(*names))
    tasks = tasks.repartition(shards * spread, "shard", "part").sortWithinPartitions("shard", "part", "batch", "uid")

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = None, []
        for b in batches:
            for r in b.to_pylist():
                if at != (r["shard"], r["part"]):
                    at, blocks = (r["shard"], r["part"]), []
                if not r["batch"]:
                    blocks.append(Block(r["uid"], _long(r["ids"]), r["kind"], r["data"], np.frombuffer(r["high"]), np.frombuffer(r["low"])))
                    continue
                best = Best(k, _long(r["bar"]), _long(r["bar_id"]))
                own_block, own_place = _long(r["own_block"]), _long(r["own_place"])
                search(blocks, _wide(r["q_kind"], r["q_data"], dims), own_block, own_place, best)
                query, score, ids = best.found()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (own_block[query], own_place[query], _long(r["ids"])[query], ids, score)],
                    ["own_block", "own_place", "query_id", "vec_id", "score"])

    found = tasks.mapInArrow(scored, "own_block long, own_place long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("own_block", "own_place").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score"))


#: DuckDB twin of ``top_k(embeddings)``
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q, ROW_NUMBER() OVER () AS own
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, a.own, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.own <> b.own WHERE a.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
