"""Shared helpers of the training-data operators: table access, staged tables
in the shared checkpoint folder, and small NumPy text helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampere.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: tables staged for a while only, innermost ``passing`` block last
_PASSING: ContextVar[tuple[list, ...]] = ContextVar("passing", default=())


def staged(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` once to the folder of ``spark.checkpoint.dir`` and read it
    back: later jobs do not recompute it and a lost executor costs nothing.
    The folder goes when the application ends (Hadoop ``deleteOnExit``), or
    with the ``passing`` block that it is staged in, unless it is ``lasting``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(jpath)
    df.write.parquet(path)
    if _PASSING.get() and not lasting:
        _PASSING.get()[-1].append((files, jpath))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing() -> Iterator[None]:
    """Tables staged in this block are deleted at its end: what outlives it
    must be staged as ``lasting``."""
    own: list = []
    token = _PASSING.set((*_PASSING.get(), own))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for files, path in own:
            files.delete(path, True)


def numbered(docs: DataFrame, name: str, order: list[Column] | None = None) -> DataFrame:
    """``row, doc``: the rows of ``docs`` as structs, written once, each with a
    number of its own, so that rows whose ids repeat or are null can be told
    apart. With ``order`` (columns of ``docs``) the numbers rise in that order."""
    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), name)


def codepoints(text: str) -> np.ndarray:
    """Code points of a text as uint32 (lone surrogates pass)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers from a rule, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup batches of rows sorted by ``keys`` so that no group of equal
    keys is cut: each yielded table holds whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        cut = batch.num_rows - 1
        same = np.ones(batch.num_rows, dtype=bool)
        for k, v in zip(keys, last):
            same &= np.asarray(batch.column(k)) == v
        other = np.flatnonzero(~same)
        cut = int(other[-1]) + 1 if len(other) else 0
        if held:
            first = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys]
            if cut == 0 and first == last:
                held.append(batch)
                continue
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        else:
            if held:
                yield pa.Table.from_batches(held)
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def spans_of(bounds: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal values, with the length at the end."""
    if len(bounds) == 0:
        return np.zeros(1, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(bounds[1:] != bounds[:-1]) + 1, [len(bounds)]))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of ``n`` nodes: the least node that its edges reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges (a, b)``; the component
    is its least node. Each round every node takes the least label among
    itself and its neighbours, and then its label's label (pointer jumping);
    tables between rounds are staged, so lineage stays short and nothing but
    one changed-count per round reaches the driver."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.where("a <> b").distinct(), "cc-edges")
    labels = staged(both.groupBy(F.col("a").alias("node"))
                    .agg(F.least(F.min("b"), F.first("a")).alias("component")), "cc-labels")
    for _ in range(rounds):
        # labels offered along edges, and to the label nodes themselves
        along = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "component")
        parents = labels.select(F.col("component").alias("node"), F.col("component"))
        offered = labels.unionAll(along).unionAll(parents).groupBy("node").agg(F.min("component").alias("component"))
        jump = offered.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = staged(offered.join(jump, F.col("component") == F.col("via"), "left")
                     .select("node", F.least("component", F.coalesce("far", "component")).alias("component")),
                     "cc-labels")
        changed = (new.join(labels.withColumnRenamed("component", "old"), "node", "left")
                   .where("old is null or old <> component").limit(1).count())
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
