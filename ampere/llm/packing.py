"""Sequence packing along a space-filling curve.

Documents become hashed n-gram count vectors, projected to three dimensions;
the Hilbert key of the quantised point orders them so that similar documents
are neighbours. Rows are range-sorted by that key and each range partition
fills sequences of ``capacity`` token ids one after the other, so only the
last sequence of a partition holds padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampere.llm.tables import seeds64, staged
from ampere.llm.words import byte_slices, span_hashes

_BUCKETS = 1024
_DIMS = 3
_BITS = 16
_GRAM = 5
#: half the width of the projected cube; points beyond it sit on its faces
_REACH = 0.25


def projection() -> np.ndarray:
    """Fixed random directions (buckets x dims) from a rule: sums of uniform
    numbers, centred so that the common part of all vectors cancels."""
    u = seeds64(_BUCKETS * _DIMS * 4, 7).reshape(_BUCKETS, _DIMS, 4) / 2.0**64
    p = u.sum(axis=2) - 2.0
    p -= p.mean(axis=0)
    return p / np.linalg.norm(p, axis=0) * np.sqrt(_BUCKETS) / 32


def project_batch(texts: pa.Array) -> np.ndarray:
    """Points (rows x dims) of a string array: counts of hashed byte n-grams,
    log-scaled, of unit length, projected. Null and short texts sit at 0."""
    n = len(texts)
    points = np.zeros((n, _DIMS))
    directions = projection()
    texts = texts.cast(pa.large_string()).fill_null("")
    lengths = np.asarray(pa.compute.binary_length(texts)).astype(np.int64)
    at = 0
    while at < n:  # blocks of a few MB, a very long text being one of its own
        size, end = 0, at
        while end < n and end - at < 512 and (end == at or size + lengths[end] <= 2_000_000):
            size += lengths[end]
            end += 1
        counts = np.zeros((end - at) * _BUCKETS)
        data = np.frombuffer(b"".join(t.as_buffer().to_pybytes() for t in texts[at:end]), np.uint8)
        row = np.repeat(np.arange(end - at), lengths[at:end])
        for lo in range(0, max(0, len(data) - _GRAM + 1), 1 << 20):
            part = data[lo : lo + (1 << 20) + _GRAM - 1]
            own = len(part) - _GRAM + 1
            h = np.zeros(own, np.uint32)
            for k in range(_GRAM):
                h *= np.uint32(0x01000193)
                h += part[k : k + own]
            h *= np.uint32(0x9E3779B1)
            whole = row[lo : lo + own] == row[lo + _GRAM - 1 : lo + _GRAM - 1 + own]
            counts += np.bincount((row[lo : lo + own] * _BUCKETS + (h >> np.uint32(22)))[whole], minlength=len(counts))
        vectors = np.log1p(counts.reshape(-1, _BUCKETS))
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        points[at:end] = (vectors / np.where(norm == 0, 1, norm)) @ directions
        at = end
    return points


def hilbert_keys(points: np.ndarray, reach: float = _REACH, bits: int = _BITS) -> np.ndarray:
    """Position (int64) along the Hilbert curve through a grid of 2^bits cells
    per dimension: Gray-code untangling of the cell coordinates, then their
    bits interleaved (Skilling 2004)."""
    side = 1 << bits
    x = np.clip((points / reach + 1) / 2 * side, 0, side - 1).astype(np.int64).T.copy()
    dims = len(x)
    q = side >> 1
    while q > 1:
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = side >> 1
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _classes() -> np.ndarray:
    """Per byte: 0 white space, 1 ASCII letter, 2 ASCII sign other than an
    apostrophe, 3 the rest (digits, apostrophes, control and non-ASCII bytes)."""
    out = np.full(256, 3, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[[*range(65, 91), *range(97, 123)]] = 1
    out[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2
    return out


_CLASS = _classes()


class CachedTokenizer:
    """Token ids of many texts at once. The word-BPE vocabulary lower-cases,
    drops white space and never joins a letter with a sign, so a text falls
    into units at white space and between ASCII letters and signs (not in a
    white-space piece with an apostrophe, whose contractions count). Units
    are told apart by 64-bit hashes; each new one is encoded once."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self._most = most
        ends = [i for token, i in self._tok.get_vocab().items() if token.endswith("</w>")]
        self._ends_word = np.zeros(self._tok.get_vocab_size(), bool)
        self._ends_word[ends] = True
        self._place: dict[int, int] = {}  # unit hash -> its number
        self._size = np.zeros(0, np.int64)  # ids of each unit
        self._begin = np.zeros(0, np.int64)
        self._used = np.zeros(0, np.int32)  # blocks of text that held it
        self._ids = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Drop the units that one block of text alone has held."""
        kept = self._used > 1
        if kept.all():
            kept[:] = False
        number = np.cumsum(kept) - 1
        self._place = {h: int(number[p]) for h, p in self._place.items() if kept[p]}
        self._ids = self._ids[np.repeat(kept, self._size)]  # ids lie in the order of the units
        self._size, self._used = self._size[kept], np.zeros(int(kept.sum()), np.int32)
        self._begin = np.cumsum(self._size) - self._size

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        """Encode new units. One of letters is one word, whose last id says so:
        thousands of them are encoded as one text."""
        words = [k for k, t in enumerate(texts) if t.isalpha()]
        rest = [k for k, t in enumerate(texts) if not t.isalpha()]
        order: list[int] = []
        sizes, ids = [self._size], [self._ids]
        joined = [words[at : at + 2000] for at in range(0, len(words), 2000)]
        for group, e in zip(joined, self._tok.encode_batch_fast([" ".join([texts[k] for k in g]) for g in joined], add_special_tokens=False)):
            found = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(self._ends_word[found]) + 1
            if len(cut) == len(group):
                order += group
                sizes.append(np.diff(cut, prepend=0))
                ids.append(found)
            else:
                rest += group
        alone = [e.ids for e in self._tok.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)]
        order += rest
        sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        ids.append(np.fromiter(chain.from_iterable(alone), np.uint32, int(sizes[-1].sum())))
        first = len(self._size)
        self._place.update(zip([hashes[k] for k in order], range(first, first + len(order))))
        self._size, self._ids = np.concatenate(sizes), np.concatenate(ids)
        self._begin = np.cumsum(self._size) - self._size
        self._used = np.concatenate((self._used, np.zeros(len(order), np.int32)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)`` of texts given as UTF-8 bytes and offsets: the
        ids of row i are ``ids[bounds[i]:bounds[i + 1]]``."""
        rows = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        if len(self._place) > self._most:
            self._forget()
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        kind = _CLASS[data]
        solid = kind > 0
        edge = np.zeros(len(data) + 1, bool)  # a piece between white space or rows begins or ends here
        edge[1:-1] = solid[1:] != solid[:-1]
        edge[[0, -1]] = True
        edge[offsets] = True
        turn = np.zeros(len(data) + 1, bool)  # a unit within a piece begins
        turn[1:-1] = (kind[1:] + kind[:-1] == 3) & (kind[1:] > 0) & (kind[:-1] > 0)
        marks = np.flatnonzero(data == 39)
        if len(marks):
            bounds = np.flatnonzero(edge)
            piece = np.unique(np.searchsorted(bounds, marks, side="right") - 1)
            for lo, hi in zip(bounds[piece].tolist(), bounds[piece + 1].tolist()):
                turn[lo:hi] = False
        cut = np.flatnonzero(edge | turn)
        start, stop = cut[:-1], cut[1:]
        real = solid[start]
        start, stop = start[real], stop[real]
        unit, distinct = pd.factorize(span_hashes(data, start, stop))
        first = np.zeros(len(distinct), np.int64)
        first[unit[::-1]] = np.arange(len(unit) - 1, -1, -1)
        hashes = distinct.tolist()
        get = self._place.get
        place = [get(x, -1) for x in hashes]
        new = [k for k, p in enumerate(place) if p < 0]
        if new:
            raw = data.tobytes()
            self._learn([hashes[k] for k in new], [raw[start[first[k]] : stop[first[k]]].decode() for k in new])
            place = [get(x) for x in hashes]
        place = np.array(place, np.int64)
        self._used[place] += 1
        of_unit = place[unit]
        size, begin = self._size[of_unit], self._begin[of_unit]
        ends = np.cumsum(size)
        ids = self._ids[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - begin, size)]
        # ids before the first unit of each row
        before = np.concatenate(([0], ends))
        return ids, before[np.searchsorted(start, offsets, side="left")]


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """One cached tokenizer per worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in
                       ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2,
                   partition_bytes: int = 16 << 20, most_partitions: int = 50_000) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` of all documents.

    Partitions are of about ``partition_bytes``, larger where that were more
    than ``most_partitions``. A document is the ids of its whole text (null: empty) and ``end_id``; it
    is cut where a sequence is full. Sequences are numbered by range partition
    (high part) and place in it (low part). Equal keys are ordered by
    ``doc_id``, so a group of copies may span partitions; repeated rows are
    packed each on its own. Other columns are ignored; an empty table gives no
    pieces.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            keys = hilbert_keys(project_batch(text))
            sizes = pa.compute.binary_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, pa.array(keys), sizes],
                                             ["doc_id", "text", "curve", "size"])

    rows = staged(rows.mapInArrow(keyed, "doc_id long, text string, curve long, size long"), "pack-keyed")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = min(max(1, -(-total // partition_bytes)), most_partitions)
    rows = rows.select("curve", "doc_id", "text").repartitionByRange(parts, "curve", "doc_id")
    rows = rows.sortWithinPartitions("curve", "doc_id", F.length("text"), "text")

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = tokenizer(vocabulary)
        sequence, used = TaskContext.get().partitionId() << 32, 0
        last = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for begin, end, data, offsets in byte_slices(batch.column("text"), 1024, 3_000_000):
                flat, bounds = tok.encode(data, offsets)
                out = []
                for doc_id, lo, hi in zip(doc_ids[begin:end], bounds[:-1].tolist(), bounds[1:].tolist()):
                    ids = flat[lo:hi].astype("<u4").tobytes() + last
                    tokens, start = len(ids) // 4, 0
                    while start < tokens:
                        n = min(tokens - start, capacity - used)
                        out.append((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens, sequence, used))
                        start += n
                        used += n
                        if used == capacity:
                            sequence, used = sequence + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], PIECES.names)

    return rows.select("doc_id", "text").mapInArrow(fill, PIECES)
