"""Similarity join of documents on word n-grams (Jaccard) by chosen paths.

Each distinct shingle set is split along random paths: at a node every token
is sampled with probability 1 / (threshold x set size), by a hash that the
node fixes, so two sets of similarity at or above the threshold are expected
to share at least one sampled token (Christiani and Pagh, 2017; Christiani,
Pagh and Sivertsen, 2018). Buckets of few sets are brute-forced on min-hash
sketches, large ones are split again by the next token; what is still large
at the last level is brute-forced in blocks. Independent runs repeat until
the target recall. The groups so found are then checked exactly, pair by
pair in blocks, so links are exact Jaccard values.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampere.llm import words as word_arrays
from ampere.llm.tables import connected_components, least_labels, mix64, numbered, passing, seeds64, spans_of, staged, whole_groups

_SKETCH = 64
_TOKENS_AT_ONCE = 1 << 15


def _shingles(w: np.ndarray, words: int) -> np.ndarray:
    if len(w) == 0:
        return np.zeros(0, np.uint64)
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
    return np.unique(mix64(h))


def shingle_sets(texts: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """Distinct hashes (sorted uint64) of the runs of ``words`` words of each
    lower-cased text. A text of fewer words has one shingle of them all; one
    without words has none."""
    for begin, end, h, row in word_arrays.slices(texts, 512):
        bounds = np.searchsorted(row, np.arange(end - begin + 1))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield _shingles(h[lo:hi], words)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The shingle set of one text."""
    return next(shingle_sets(pa.array([(text or "").lower()]), words))


_SLOPES = seeds64(_SKETCH, 11) | np.uint64(1)


def sketch(tokens: np.ndarray) -> bytes:
    """One byte for each of 64 min-hashes."""
    least = np.full(_SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 2048):
        np.minimum(least, (_SLOPES[:, None] * tokens[None, at : at + 2048]).min(axis=1), out=least)
    return (mix64(least) & np.uint64(255)).astype(np.uint8).tobytes()


def split(tokens: np.ndarray, nodes: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Chosen tokens at each node: ``(index of the node, child node)``."""
    parents, children = [], []
    for at in range(0, len(tokens), _TOKENS_AT_ONCE):
        r = mix64(tokens[None, at : at + _TOKENS_AT_ONCE] ^ nodes[:, None])
        i, j = np.nonzero(r < limit)
        parents.append(i)
        children.append(mix64(r[i, j] + nodes[i]))
    if not parents:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(parents), np.concatenate(children)


@dataclass(frozen=True)
class JoinParams:
    """``small``: a bucket of more sets is split again, up to ``levels``
    times; ``sketch_block``, ``block``: sets per side of a block compared by
    sketches and exactly; ``recall``: the chance that a pair at the threshold
    meets in some bucket."""

    words: int = 5
    threshold: float = 0.8
    recall: float = 0.99
    levels: int = 3
    small: int = 8192
    sketch_block: int = 8192
    block: int = 512

    @property
    def runs(self) -> int:
        # a pair at the threshold shares c tokens, c = 2t / (1 + t) of a set's size,
        # each sampled with probability 1 / (t x size): Poisson with mean 2 / (1 + t)
        met = 1.0
        for _ in range(self.levels):
            met = 1.0 - math.exp(-met * 2.0 / (1.0 + self.threshold))
        return max(1, math.ceil(math.log(1.0 - self.recall) / math.log(1.0 - met)))

    @property
    def alike(self) -> int:
        """Equal sketch bytes asked of a pair: 3.5 deviations under the mean."""
        t = self.threshold
        return max(0, math.ceil(_SKETCH * t - 3.5 * math.sqrt(_SKETCH * t * (1 - t))))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def path_table(docs: DataFrame, p: JoinParams) -> DataFrame:
    """One row per document: digest of its shingle set, set size, sketch, and
    its chosen paths (``p1``; then ``q2 -> p2`` and ``q3 -> p3``, a parent
    for each path)."""
    names = ["doc_id", "digest", "n", "sketch", "p1"] + [f"{c}{k}" for k in range(2, p.levels + 1) for c in "qp"]
    roots = seeds64(p.runs, 5)
    none = np.zeros(0, np.uint64)

    def paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                digests, sizes, sketches = [], [], []
                lists: list[list[np.ndarray]] = [[] for _ in names[4:]]
                for s in shingle_sets(part.column("text"), p.words):
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    sketches.append(sketch(s))
                    limit = np.uint64(min(2.0**64 - 2048, 2.0**64 / (p.threshold * max(1, len(s)))))
                    nodes = roots
                    for level in range(1, p.levels + 1):
                        i, child = split(s, nodes, limit) if len(s) else (np.zeros(0, np.int64), none)
                        if level == 1:
                            lists[0].append(child)
                        else:
                            lists[2 * level - 3].append(nodes[i])
                            lists[2 * level - 2].append(child)
                        nodes = child
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(sketches, pa.binary()), *map(_lists, lists)], names)

    schema = "doc_id long, digest binary, n long, sketch binary, " + ", ".join(f"{c} array<long>" for c in names[4:])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(paths, schema)


def _crowded(rows: DataFrame) -> DataFrame:
    """``(path, c)`` for the paths of at least two sets."""
    return rows.groupBy("path").agg(F.count("*").alias("c")).where("c > 1")


def buckets(sets: DataFrame, p: JoinParams) -> DataFrame:
    """``(path, set, c)``: members of the buckets to brute-force, with the
    bucket's size. A bucket of over ``small`` sets is replaced by its
    children, except at the last level."""
    rows = sets.select("set", F.explode("p1").alias("path"))
    leaves = []
    for level in range(1, p.levels + 1):
        counts = staged(_crowded(rows), f"paths-{level}")
        last = level == p.levels
        own = counts if last else counts.where(F.col("c") <= p.small)
        leaves.append(rows.join(own, "path").select("path", "set", "c"))
        if not last:
            large = counts.where(F.col("c") > p.small).select(F.col("path").alias("parent"))
            pairs = sets.select("set", F.explode(F.arrays_zip(f"q{level + 1}", f"p{level + 1}")).alias("e"))
            pairs = pairs.select("set", F.col(f"e.q{level + 1}").alias("parent"), F.col(f"e.p{level + 1}").alias("path"))
            rows = pairs.join(large, "parent").select("set", "path")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionAll(more)
    return out


def in_blocks(rows: DataFrame, group: str, count: str, block: int) -> DataFrame:
    """Deal each group of ``count`` rows into blocks of about ``block`` and
    every pair of blocks to one ``(group, lo, hi)``: a row joins as many as
    there are blocks. ``own``: the row's block."""
    n = F.ceil(F.col(count) / F.lit(float(block)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set", group), n))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    return rows.drop("other")


def _runs(t: pa.Table, group: str) -> np.ndarray:
    """Bounds of the runs of equal (group, lo, hi)."""
    cuts = {0, t.num_rows}
    for k in (group, "lo", "hi"):
        cuts.update(spans_of(t.column(k).to_numpy()).tolist())
    return np.array(sorted(cuts))


def loose_edges(members: DataFrame, p: JoinParams) -> DataFrame:
    """``(a, b)`` edges that join the sets of a bucket whose sketches and
    sizes allow the threshold: a spanning forest per bucket, never all pairs."""

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["path", "lo", "hi"]):
            bounds = _runs(t, "path")
            rest = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(t.num_rows)  # rows of the run from here on
            sets, n = t.column("set").to_numpy(), t.column("n").to_numpy()
            own, lo, hi = (t.column(c).to_numpy() for c in ("own", "lo", "hi"))
            bytes_ = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, _SKETCH)
            label = np.arange(t.num_rows)
            ea, eb, held = [], [], 0
            left = np.flatnonzero(rest > 1)
            d = 1
            while len(left):
                a, b = left, left + d
                fits = np.minimum(n[a], n[b]) >= p.threshold * np.maximum(n[a], n[b]) - 1e-9
                fits &= label[a] != label[b]  # a spanning forest needs no more edges between these
                # a pair of one block is seen in that block's own group alone
                fits &= (lo[a] == hi[a]) | (own[a] != own[b])
                a, b = a[fits], b[fits]
                good = (bytes_[a] == bytes_[b]).sum(axis=1) >= p.alike
                ea.append(a[good])
                eb.append(b[good])
                held += int(good.sum())
                d += 1
                left = left[rest[left] > d]
                if held > t.num_rows or not len(left):
                    label = least_labels(t.num_rows, np.concatenate([label, *ea]), np.concatenate([np.arange(t.num_rows), *eb]))
                    ea, eb, held = [], [], 0
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(sets[moved]), pa.array(sets[label[moved]])], ["a", "b"])

    return (members.repartition("path", "lo", "hi").sortWithinPartitions("path", "lo", "hi", "set")
            .select("path", "lo", "hi", "own", "set", "n", "sketch").mapInArrow(link, "a long, b long"))


def overlaps(tokens: list[np.ndarray]) -> np.ndarray:
    """Matrix of common tokens of every two sets."""
    m = len(tokens)
    flat = np.concatenate(tokens)
    row = np.repeat(np.arange(m), [len(t) for t in tokens])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    bounds = spans_of(flat)
    many = np.diff(bounds) > 1  # a token of one set overlaps with nothing
    column = np.repeat(np.where(many, np.cumsum(many) - 1, -1), np.diff(bounds))
    common = np.zeros((m, m), np.float32)
    width = max(64, min(4096, (1 << 22) // max(1, m)))
    for at in range(0, int(many.sum()), width):
        lo, hi = np.searchsorted(np.maximum.accumulate(column), [at, at + width])
        inside = column[lo:hi]
        keep = inside >= at
        x = np.zeros((m, width), np.float32)
        x[row[lo:hi][keep], inside[keep] - at] = 1
        common += x @ x.T
    return common


def exact_links(docs: DataFrame, members: DataFrame, p: JoinParams) -> DataFrame:
    """``(set, label, links)`` per set and block pair: number of other sets at
    or above the threshold, and the least set that links lead to there."""

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column("set"), part.column("component"), part.column("c"),
                     pa.array([x.tobytes() for x in shingle_sets(part.column("text"), p.words)], pa.binary())],
                    ["set", "component", "c", "tokens"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["component", "lo", "hi"]):
            bounds = _runs(t, "component")
            sets = t.column("set").to_numpy()
            own, lo, hi = (t.column(c).to_numpy() for c in ("own", "lo", "hi"))
            links = np.zeros(t.num_rows, np.int64)
            ea, eb = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s < 2:
                    continue
                of = [np.frombuffer(x, np.uint64) for x in t.column("tokens").slice(s, e - s).to_pylist()]
                n = np.array([len(x) for x in of], np.float64)
                if e - s == 2:
                    common = np.full((2, 2), len(np.intersect1d(of[0], of[1], assume_unique=True)), np.float64)
                else:
                    common = overlaps(of)
                good = common * (1 + p.threshold) >= p.threshold * (n[:, None] + n[None, :]) - 1e-6
                good &= sets[s:e, None] != sets[None, s:e]
                if lo[s] != hi[s]:
                    good &= own[s:e, None] != own[None, s:e]
                links[s:e] = good.sum(axis=1)
                a, b = np.nonzero(np.triu(good, 1))
                ea.append(a + s)
                eb.append(b + s)
            if ea:
                label = least_labels(t.num_rows, np.concatenate(ea), np.concatenate(eb))
                kept = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets[kept]), pa.array(sets[label[kept]]), pa.array(links[kept])], ["set", "label", "links"])

    # always a merge join: the members grow with the corpus, so the plan is the same at every size
    rows = (docs.select(F.col("doc_id").cast("long").alias("set"), F.lower("text").alias("text")).join(members.hint("merge"), "set")
            .select("set", "component", "c", "text")
            .mapInArrow(tokens, "set long, component long, c long, tokens binary"))
    rows = in_blocks(rows, "component", "c", p.block)
    return (rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "set")
            .select("component", "lo", "hi", "own", "set", "tokens").mapInArrow(verify, "set long, label long, links long"))


def near_duplicates(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, n_copies``.

    ``class_id``: least id among the documents that equal shingle sets and
    links (exact Jaccard of word shingles >= ``threshold``) connect to it;
    ``n_links``: other distinct shingle sets linked to its own; ``n_copies``:
    documents with the same shingle set, itself included. Texts without words
    (null, empty) are copies of each other. Rows that share an id count as one
    document of links; a null id never stands for a class (its row has the
    class of its copies, or null). Other columns are ignored.
    """
    p = params
    rows = staged(path_table(docs, p), "join-paths")
    first = [c for c in rows.columns if c not in ("doc_id", "digest")]
    sets = rows.where("doc_id is not null").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", *first)).alias("r"))
    sets = staged(sets.select("digest", "copies", F.col("r.doc_id").alias("set"), *[F.col(f"r.{c}") for c in first]), "join-sets")
    found = buckets(sets, p).join(sets.select("set", "n", "sketch"), "set")
    edges = loose_edges(in_blocks(found, "path", "c", p.sketch_block), p)
    loose = connected_components(edges)
    sizes = loose.groupBy("component").agg(F.count("*").alias("c"))
    members = loose.withColumnRenamed("node", "set").join(sizes, "component")
    exact = staged(exact_links(docs, members, p), "join-links")
    classes = connected_components(exact.select(F.col("set").alias("a"), F.col("label").alias("b")))
    links = exact.groupBy("set").agg(F.sum("links").alias("n_links"))
    of_set = (sets.select("digest", "copies", "set").join(classes.withColumnRenamed("node", "set"), "set", "left")
              .join(links, "set", "left")
              .select("digest", F.coalesce("component", "set").alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("copies").alias("n_copies")))
    return rows.select("doc_id", "digest").join(of_set, "digest", "left").select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one_of_each(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One row of each class, all columns: the one with the least id, a null
    id after all others. Rows are told apart by a number of their own, so two
    texts that share an id, or have none, are judged each by its text; of
    repeated rows one stays."""
    rows = numbered(docs, "join-docs")
    with passing():
        classes = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), params)
        known = rows.select("row", F.col("doc.doc_id").alias("id")).join(classes.select(F.col("doc_id").alias("row"), "class_id"), "row")
        kept = known.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
        kept = staged(kept.select(F.col("first.row").alias("row")), "join-kept", lasting=True)
    return rows.join(kept.hint("merge"), "row", "left_semi").select("doc.*")  # one plan at every size


#: DuckDB twin of ``near_duplicates(documents)``: all pairs that share a shingle
ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0) x),
digests AS (
  SELECT d.doc_id, COUNT(s) AS n, md5(COALESCE(string_agg(s, chr(10) ORDER BY s), '')) AS digest
  FROM documents d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id),
sets AS (SELECT digest, MIN(doc_id) AS rep, COUNT(*) AS copies, MAX(n) AS n FROM digests GROUP BY digest),
members AS (SELECT rep, n, s FROM sets JOIN shingles ON doc_id = rep),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM members a JOIN members b ON a.s = b.s AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING COUNT(*) >= 0.8 * (a.n + b.n - COUNT(*)) - 1e-9),
reach AS (SELECT rep AS node, rep AS other FROM sets UNION SELECT node, b FROM reach JOIN links ON a = other),
classes AS (SELECT node, MIN(other) AS class_id FROM reach GROUP BY node)
SELECT doc_id, class_id, (SELECT COUNT(*) FROM links WHERE a = rep) AS n_links, copies AS n_copies
FROM digests JOIN sets USING (digest) JOIN classes ON node = rep"""
