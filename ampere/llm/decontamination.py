"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages become TF-IDF rows over hashed words, with document
frequencies counted over the whole corpus; a distributed randomised SVD
(Halko, Martinsson and Tropp, 2011) of those rows gives a latent space.
Windows of every document are folded into it and compared with the passages
by cosine; candidates are confirmed by the longest common subsequence of
words and by the passage's answer (its last words), which also finds
paraphrases that keep most words in order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampere.llm import words as word_arrays
from ampere.llm.tables import mix64, numbered, passing, spans_of, staged


@dataclass(frozen=True)
class RetrievalParams:
    bits: int = 17  # hashed words: 2^bits features
    rank: int = 256  # dimensions of the latent space
    oversample: int = 16
    passage: int = 64  # words of a benchmark passage; longer items are cut
    stride: int = 16  # words of a block; a window is three blocks
    min_terms: int = 3  # weighted words that a window needs
    cosine: float = 0.4  # between a window and a passage
    coverage: float = 0.45  # of the passage's length, along its direction
    lcs: float = 0.75  # share of the passage's words found in order
    lcs_with_answer: float = 0.6
    answer: int = 8  # last words of a passage, taken as its answer
    answer_share: float = 0.75
    #: words in more documents and in more passages than this weigh nothing; those of a
    #: passage that many documents repeat are common in documents only, and still count
    stop_share: float = 0.05
    passages_at_once: int = 20_000  # more are worked off in turns


def _feature(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64)


def passages(benchmark: DataFrame, p: RetrievalParams) -> DataFrame:
    """``(item_id, passage, words)``: items cut to passages of at most
    ``p.passage`` words (as 64-bit hashes); items without words have none."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            items = batch.column("item_id").to_pylist()
            for begin, end, h, row in word_arrays.slices(batch.column("text")):
                for i in range(begin, end):
                    w = h[row == i - begin]
                    pieces = -(-len(w) // p.passage)
                    for k, piece in enumerate(np.array_split(w, pieces) if pieces else []):
                        out.append((items[i], k, piece.tobytes()))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                              pa.array(columns[2], pa.binary())], ["item_id", "passage", "words"])

    return (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
            .mapInArrow(cut, "item_id long, passage long, words binary").distinct())


def _slices(batch: pa.RecordBatch, gap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(begin, words, document, first)`` of some documents of a batch: their
    words after each other from whole blocks of ``gap`` on, with three empty
    blocks after each; the document of each place (-1: none) and the place of
    each document's first word."""
    for begin, end, h, row in word_arrays.slices(batch.column("text")):
        n = np.bincount(row, minlength=end - begin)
        first = np.concatenate(([0], np.cumsum(-(-n // gap) * gap + 3 * gap)))
        at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + first[row]
        words = np.zeros(first[-1], np.uint64)
        document = np.full(first[-1], -1, np.int64)
        words[at], document[at] = h, row
        yield begin, words, document, first


def document_frequencies(docs: DataFrame, features: np.ndarray, p: RetrievalParams) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each of ``features`` occurs:
    counted over all documents, summed per task and then by a shuffle."""
    wanted = docs.sparkSession.sparkContext.broadcast(features)  # at most 2^bits numbers

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << p.bits, -1, np.int64)
        place[wanted.value] = np.arange(len(wanted.value))
        totals = np.zeros(len(wanted.value) + 1, np.int64)
        for batch in batches:
            totals[-1] += batch.num_rows
            for _, words, document, _ in _slices(batch, p.stride):
                real = document >= 0
                f = place[_feature(words[real], p.bits)]
                pairs = np.unique(document[real][f >= 0] * (len(totals)) + f[f >= 0])
                totals += np.bincount(pairs % len(totals), minlength=len(totals))
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["place", "n"])

    rows = docs.select("text").mapInArrow(count, "place long, n long")
    totals = np.zeros(len(features) + 1, np.int64)
    for r in rows.groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most 2^bits + 1 rows
        totals[r["place"]] = r["n"]
    return int(totals[-1]), totals[:-1]


def _directions(features: np.ndarray, width: int) -> np.ndarray:
    """Fixed random numbers (features x width), near normal, from a rule."""
    seeds = features.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)[None, :]
    u = mix64(seeds + np.uint64(0x51ED2701))
    parts = [((u >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.float32) for k in range(4)]
    return ((sum(parts) / 65535.0 - 2.0) * np.sqrt(3.0)).astype(np.float32)


def randomised_svd(rows: DataFrame, columns: int, rank: int, oversample: int, power: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors ``(columns x rank)`` and singular values
    of the sparse matrix ``rows (places array<long>, weights array<float>)``.

    Rows stay on the executors: each pass multiplies them with a matrix of
    ``columns x (rank + oversample)`` numbers, sums the small Gram matrix, and
    sums A^T Q by column through a shuffle. Only those two bounded matrices
    reach the driver.
    """
    sc = rows.sparkSession.sparkContext
    width = min(rank + oversample, max(1, columns))

    def products(batch: pa.RecordBatch, matrix: np.ndarray):
        lists, weights = batch.column("places"), batch.column("weights")
        place = lists.flatten().to_numpy().astype(np.int64)
        weight = weights.flatten().to_numpy().astype(np.float32)
        sizes = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        y = np.zeros((batch.num_rows, matrix.shape[1]), np.float32)
        for at in range(0, len(place), 1 << 16):
            part = slice(at, at + (1 << 16))
            np.add.at(y, row[part], matrix[place[part]] * weight[part, None])
        return place, weight, row, y

    def gram(matrix) -> np.ndarray:
        def one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros((matrix.value.shape[1],) * 2)
            for batch in batches:
                y = products(batch, matrix.value)[3].astype(np.float64)
                g += y.T @ y
            if g.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(g))), pa.array(list(g), pa.list_(pa.float64()))], ["i", "v"])

        total = np.zeros((matrix.value.shape[1],) * 2)
        for r in _summed(rows.mapInArrow(one, "i long, v array<double>"), "i").collect():  # width rows
            total[r["i"]] = r["v"]
        return total

    def back(matrix, turn: np.ndarray) -> np.ndarray:
        def one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place, weight, row, y = products(batch, matrix.value)
                q = y @ turn
                used, to = np.unique(place, return_inverse=True)
                sums = np.zeros((len(used), q.shape[1]))
                for at in range(0, len(place), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    np.add.at(sums, to[part], q[row[part]] * weight[part, None])
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(sums), pa.list_(pa.float64()))], ["i", "v"])

        total = np.zeros((columns, turn.shape[1]), np.float32)
        for r in _summed(rows.mapInArrow(one, "i long, v array<double>"), "i").toLocalIterator():  # at most `columns` rows
            total[r["i"]] = r["v"]
        return total

    matrix = _directions(np.arange(columns), width)
    for turn_number in range(power + 1):
        sent = sc.broadcast(matrix)
        values, vectors = np.linalg.eigh(gram(sent))
        good = values > max(values.max(), 0) * 1e-10
        if not good.any():
            return np.zeros((columns, 0), np.float32), np.zeros(0)
        b = back(sent, (vectors[:, good] / np.sqrt(values[good])).astype(np.float32))
        if turn_number < power:
            matrix = np.linalg.qr(b)[0].astype(np.float32)
    u, s, _ = np.linalg.svd(b.astype(np.float64), full_matrices=False)
    keep = (s > s[0] * 1e-6)[: min(rank, len(s))]
    return u[:, : len(keep)][:, keep].astype(np.float32), s[: len(keep)][keep]


def _summed(rows: DataFrame, key: str) -> DataFrame:
    """Element-wise sums of the arrays ``v`` by ``key``."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(key).to_pylist(), batch.column("v")):
                v = v.values.to_numpy()
                sums[k] = sums[k] + v if k in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], [key, "v"])

    return rows.repartition(8, key).mapInArrow(add, f"{key} long, v array<double>")


class Lcs:
    """Length of the longest common subsequence with a fixed word list, by
    bit-parallel dynamic programming."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.masks: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            self.masks[w] = self.masks.get(w, 0) | (1 << i)

    def length(self, words: list[int]) -> int:
        full = (1 << self.n) - 1
        row = full
        for w in words:
            hit = self.masks.get(w)
            if hit:
                u = row & hit
                row = ((row + u) | (row - u)) & full
        return self.n - row.bit_count()


@dataclass
class LatentIndex:
    items: list[int]
    words: list[np.ndarray]
    features: np.ndarray  # feature numbers with a weight
    idf: np.ndarray
    basis: np.ndarray  # features x rank
    vectors: np.ndarray  # passages x rank, of unit length
    lengths: np.ndarray  # of the vectors before that


def build_index(docs: DataFrame, found: DataFrame, p: RetrievalParams) -> LatentIndex | None:
    """Fit the latent space of the passages ``found`` (staged, at most
    ``passages_at_once``) with corpus-wide document frequencies."""
    rows = found.orderBy("item_id", "passage").collect()  # bounded by passages_at_once x passage words
    if not rows:
        return None
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    features = np.unique(np.concatenate([_feature(w, p.bits) for w in words]))
    n, df = document_frequencies(docs, features, p)
    held = np.bincount(np.searchsorted(features, np.concatenate([np.unique(_feature(w, p.bits)) for w in words])))
    stop = (df > p.stop_share * n) & (held > max(2.0, p.stop_share * len(words)))
    idf = np.where(stop, 0.0, np.log((1.0 + n) / (1.0 + df)) + 1.0).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((features, idf))  # at most 2^bits numbers each

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, idf = sent.value
        for batch in batches:
            places, weights = [], []
            for w in batch.column("words").to_pylist():
                place = np.searchsorted(features, _feature(np.frombuffer(w, np.uint64), p.bits))
                place, tf = np.unique(place, return_counts=True)
                weight = tf * idf[place]
                norm = np.linalg.norm(weight)
                places.append(place[weight > 0].tolist())
                weights.append((weight[weight > 0] / norm).tolist() if norm else [])
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float32()))],
                                             ["places", "weights"])

    matrix = found.select("words").mapInArrow(weigh, "places array<long>, weights array<float>")
    basis, _ = randomised_svd(matrix, len(features), p.rank, p.oversample)
    vectors = np.zeros((len(words), basis.shape[1]), np.float32)
    for k, w in enumerate(words):
        place = np.searchsorted(features, _feature(w, p.bits))
        vectors[k] = (basis[place] * idf[place, None]).sum(axis=0)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return LatentIndex([r["item_id"] for r in rows], words, features, idf, basis, vectors / np.where(norm == 0, 1, norm), norm[:, 0])


LEAKS = "doc_id long, item_id long, start_word long, cosine double, lcs double, answer_found boolean"


def search(docs: DataFrame, index: LatentIndex, p: RetrievalParams) -> DataFrame:
    """Confirmed ``(doc_id, item_id, ...)`` rows: one per document row and item."""
    sent = docs.sparkSession.sparkContext.broadcast(index)  # passages_at_once passages, 2^bits x rank numbers at most

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        weight = np.zeros(1 << p.bits, np.float32)
        weight[ix.features] = ix.idf
        basis = ix.basis * ix.idf[:, None]
        place = np.zeros(1 << p.bits, np.int64)
        place[ix.features] = np.arange(len(ix.features))
        # a window that holds the wanted share of a passage is at least so long in its direction
        held = np.array([min(1.0, 3 * p.stride / len(w)) for w in ix.words], np.float32)
        least = np.maximum(p.coverage * held * ix.lengths, 1e-6)
        passages = [Lcs(w) for w in ix.words]
        answers = [Lcs(w[-p.answer :]) for w in ix.words]
        for batch in batches:
            out: dict[tuple[int, int], tuple] = {}
            ids = batch.column("doc_id").to_pylist()
            for begin, words, document, first in _slices(batch, p.stride):
                for window, k, cosine in candidates(words, weight, place, basis, ix.vectors, least):
                    lo = window * p.stride
                    d = int(np.searchsorted(first, lo, side="right")) - 1
                    n = passages[k].n
                    start, end = max(first[d], lo - n), min(first[d + 1], lo + 3 * p.stride + n)
                    segment = words[start:end][document[start:end] == d].tolist()
                    share = passages[k].length(segment) / n
                    if share < p.lcs_with_answer:
                        continue
                    answered = answers[k].length(segment) >= p.answer_share * answers[k].n
                    if share >= p.lcs or answered:
                        row = (share, cosine, answered, int(lo - first[d]))
                        key = (begin + d, ix.items[k])
                        if key not in out or (row[0], row[1], -row[3]) > (out[key][0], out[key][1], -out[key][3]):
                            out[key] = row
            rows = [(ids[i], item, r[3], r[1], r[0], r[2]) for (i, item), r in sorted(out.items())]
            yield pa.RecordBatch.from_pylist([dict(zip(_LEAK_NAMES, r)) for r in rows], _LEAK_SCHEMA)

    def candidates(words, weight, place, basis, vectors, least):
        f = _feature(words, p.bits)
        at = np.flatnonzero((weight[f] > 0) & (words != 0))
        blocks = len(words) // p.stride + 3
        count = np.bincount(at // p.stride, minlength=blocks)
        window = count[:-2] + count[1:-1] + count[2:]
        chosen = np.flatnonzero(window >= p.min_terms)
        needed = np.zeros(blocks, bool)
        for k in range(3):
            needed[chosen + k] = True
        at = at[needed[at // p.stride]]
        for part in range(0, len(chosen), 2048):
            these = chosen[part : part + 2048]
            low, high = these[0], these[-1] + 3
            own = at[np.searchsorted(at, low * p.stride) : np.searchsorted(at, high * p.stride)]
            block = own // p.stride
            bounds = spans_of(block)
            sums = np.zeros((high - low, basis.shape[1]), np.float32)
            sums[block[bounds[:-1]] - low] = np.add.reduceat(basis[place[f[own]]], bounds[:-1], axis=0)
            z = sums[these - low] + sums[these - low + 1] + sums[these - low + 2]
            norm = np.linalg.norm(z, axis=1)
            along = z @ vectors.T
            for i, k in zip(*np.nonzero((along >= p.cosine * norm[:, None]) & (along >= least))):
                yield int(these[i]), int(k), float(along[i, k] / norm[i])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, LEAKS)


_LEAK_NAMES = ("doc_id", "item_id", "start_word", "cosine", "lcs", "answer_found")
_LEAK_SCHEMA = pa.schema(list(zip(_LEAK_NAMES, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: RetrievalParams = RetrievalParams()) -> DataFrame:
    """Documents that hold a benchmark passage: ``doc_id, item_id, start_word,
    cosine, lcs, answer_found`` per document row and item, at its best window.

    Every window of every whole text is searched against every passage; a
    benchmark of more than ``passages_at_once`` passages is worked off in
    turns. Null and empty texts or items match nothing; repeated rows of an
    item count once, those of a document each give their rows; either table
    may be empty; other columns are ignored.
    """
    p = params
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    found = staged(passages(benchmark, p), "leak-passages")
    turns = -(-found.count() // p.passages_at_once)
    out = None
    for turn in range(turns):
        part = found if turns == 1 else found.where(F.pmod(F.xxhash64("item_id", "passage", "words"), F.lit(2 * turns)).isin(2 * turn, 2 * turn + 1))
        index = build_index(docs, part, p)
        rows = search(docs, index, p) if index else None
        out = rows if out is None else out.unionAll(rows) if rows is not None else out
    if out is None:
        return docs.sparkSession.createDataFrame([], LEAKS)
    if turns > 1:  # passages of one item may have come up in several turns
        best = F.max_by(F.struct("start_word", "cosine", "lcs", "answer_found"), F.struct("lcs", "cosine", -F.col("start_word")))
        out = out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, params: RetrievalParams = RetrievalParams()) -> DataFrame:
    """Rows without a benchmark passage, all columns. Rows are told apart by a
    number of their own: each goes or stays by its own text, whether its id is
    null or another row's too. The list of leaks is small beside the corpus."""
    rows = numbered(docs, "leak-docs")
    with passing():
        leaked = find_leaks(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), benchmark, params)
        leaked = staged(leaked.select(F.col("doc_id").alias("row")).distinct(), "leaks", lasting=True)
    return rows.join(leaked, "row", "left_anti").select("doc.*")
