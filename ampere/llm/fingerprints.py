"""Lempel-Ziv phrase fingerprints.

A document is parsed into dictionary phrases (each the shortest string not
seen before as a phrase); the set of phrase hashes is summed up by its least
hashes, and two such signatures estimate the Jaccard likeness of the phrase
sets, a stand-in for compression distance (Raff and Nicholas, 2017).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampere.llm.tables import codepoints, mix64, staged

#: least hashes that a fingerprint keeps
SIZE = 64
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
_BLOCK = 1 << 16


def parse(text: str, phrases: dict[str, None], rest: str = "") -> str:
    """Add the phrases of ``text`` to the ordered ``phrases``; ``rest`` is the
    unfinished phrase before it, the new one is returned."""
    p = rest
    for c in text:
        p += c
        if p not in phrases:
            phrases[p] = None
            p = ""
    return p


def phrase_hashes(phrases: dict[str, None], rest: str) -> np.ndarray:
    """64-bit hash of each phrase: a polynomial of its code points, mixed."""
    strings = [*phrases, rest] if rest else list(phrases)
    if not strings:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    points = codepoints("".join(strings)).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(size)
    h = np.zeros(len(size), np.uint64)
    begin = 0
    while begin < len(size):  # blocks of phrases, so that powers stay short
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + _BLOCK)))
        lo = int(ends[begin] - size[begin])
        part = points[lo : int(ends[end - 1])]
        place = np.arange(len(part)) - np.repeat(ends[begin:end] - size[begin:end] - lo, size[begin:end])
        powers = _powers(int(size[begin:end].max()))
        h[begin:end] = np.add.reduceat(part * powers[place], ends[begin:end] - size[begin:end] - lo)
        begin = end
    return mix64(h + size.astype(np.uint64))


_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 256) - 1, _BASE, np.uint64), dtype=np.uint64)))
    return _POWERS[0][:n]


def signature(phrases: dict[str, None], rest: str) -> np.ndarray:
    """The ``SIZE`` least 32-bit hashes of the phrase set, sorted."""
    h = np.unique((phrase_hashes(phrases, rest) >> np.uint64(32)).astype(np.uint32))
    return h[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard of two phrase sets: the share of both among the least
    ``SIZE`` hashes of their union; 1.0 for two empty texts."""
    if len(a) == 0 and len(b) == 0:
        return 1.0
    both, n = np.unique(np.concatenate((a, b)), return_counts=True)
    least = n[:SIZE]
    return float((least == 2).sum() / len(least))


def fingerprint(text: str | None) -> str:
    """Hex text of the signature of a text (null: empty)."""
    phrases: dict[str, None] = {}
    return _packed(signature(phrases, parse(text or "", phrases))).hex()


def _packed(sig: np.ndarray) -> bytes:
    return sig.astype(">u4").tobytes()


class Parsed:
    """A text's phrases at its half, from which an edited text goes on, and
    the signature of the whole text."""

    def __init__(self, doc_id: int, text: str):
        self.doc_id, self.text = doc_id, text
        self.kept = len(text) - len(text) // 2
        self.half: dict[str, None] = {}
        self.rest = parse(text[: self.kept], self.half)
        whole = self.half.copy()
        self.signature = signature(whole, parse(text[self.kept :], whole, self.rest))

    def row(self, following: "Parsed") -> tuple:
        n = len(self.text)
        tail = following.text[: n // 2]
        edited = self.text[: self.kept] + tail
        phrases = self.half.copy()
        sig = signature(phrases, parse(tail, phrases, self.rest))
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (self.doc_id, n, digest, _packed(self.signature), _packed(sig),
                likeness(self.signature, sig), likeness(self.signature, following.signature))


#: fingerprints stay bytes until the result, where they become hex text
ROWS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
        "near_edited double, near_next double")
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def fingerprint_edits(docs: DataFrame, partition_rows: int = 5_000, most_partitions: int = 50_000) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's
    beginning (see ``ROWS``).

    "Next" is the row after it in the order of ``doc_id`` (then text); the
    last row's is the first. Null texts count as empty, null ids come first;
    repeated rows follow each other; a single row is its own next; other
    columns are ignored; an empty table gives no rows.

    Texts are shuffled once, by range of ``doc_id`` (about ``partition_rows``
    rows a range, more where that were over ``most_partitions`` ranges); within
    a partition the next row is at hand. The first and last row of each partition are written
    with the results and joined in a second, small step.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = min(max(1, -(-docs.count() // partition_rows)), most_partitions)
    crc = F.crc32("text")  # only splits rows that share an id
    rows = rows.repartitionByRange(parts, "doc_id", crc).sortWithinPartitions("doc_id", crc, "text")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names, types = [*_NAMES, "part", "end", "text"], [*_TYPES, pa.int64(), pa.string(), pa.string()]
        before = first = None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                this = Parsed(doc_id, text)
                if before is None:
                    first = this
                else:
                    out.append((*before.row(this), None, None, None))
                before = this
            yield _columns(out, names, types)
        if before is not None:
            ends = [(p.doc_id, *[None] * 6, part, end, p.text) for end, p in (("first", first), ("last", before))]
            yield _columns(ends, names, types)

    found = staged(rows.mapInArrow(walk, f"{ROWS}, part long, end string, text string"), "phrase-rows")
    ends = found.where("end is not null").select("part", "end", "doc_id", "text")  # two rows per partition
    firsts = ends.where("end = 'first'").select("part", F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    order = Window.orderBy("part")  # over the numbers of the partitions only
    numbers = firsts.select("part").withColumn("after", F.lead("part").over(order))
    numbers = numbers.select("part", F.coalesce("after", F.min("part").over(Window.partitionBy())).alias("after"))
    joins = (ends.where("end = 'last'").select("part", "doc_id", "text").join(numbers, "part")
             .join(firsts.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "next_id", "next_text"))

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "next_id", "next_text")]
            yield _columns([Parsed(i, t).row(Parsed(j, u)) for i, t, j, u in zip(*columns)], _NAMES, _TYPES)

    out = found.where("end is null").select(*_NAMES).unionAll(joins.mapInArrow(across, ROWS))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
