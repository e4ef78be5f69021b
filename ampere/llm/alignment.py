"""Alignment of the tokens of two vocabularies over the same bytes.

Both tokenizers read a space and the text; tokens are laid out over its bytes.
In each batch of documents pandas ``merge_asof``, keyed by document, finds for
every token start the other side's token that covers it; the union of both
directions is all overlapping pairs (links), and the offsets where tokens of
both sides end cut them into groups. How often two ids are linked in the whole
corpus is counted by Spark from one row per document and distinct pair.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampere.llm.tables import spans_of, staged
from ampere.llm.words import byte_slices, span_hashes

#: bytes of text aligned at a time, and of distinct words encoded as one text
_SLICE, _JOINED = 1_500_000, 100_000


def _byte_level() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class BytePairs:
    """A byte-level vocabulary of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = _byte_level()
        entries = self._tok.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * self._tok.get_vocab_size()
        for entry, i in entries.items():
            self.bytes[i] = bytes(letters[c] for c in entry if c in letters)

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tok.encode_batch_fast(units, add_special_tokens=False)]


class Pieces:
    """A SentencePiece vocabulary that itself adds the space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self._tok = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self._tok.get_piece_size()):
            piece = self._tok.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self._tok.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, units: list[str]) -> list[list[int]]:
        return self._tok.encode([u[1:] for u in units], num_threads=1)


class Side:
    """Token ids of units of text (a space and what follows) for one vocabulary."""

    def __init__(self, vocabulary: BytePairs | Pieces):
        self._vocabulary = vocabulary
        self.bytes = vocabulary.bytes
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self._texts = {}
        for sep in (b",", b"|", b";"):
            self._texts[sep] = [b"%d%s" % (i, sep) for i in range(len(self.bytes))]

    def labels(self, sep: bytes) -> list[bytes]:
        return self._texts[sep]

    def _exact(self, ids: list[int], unit: str) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == unit.encode()

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, count, exact)``: the ids of all units one after the other,
        how many each has, and whether their bytes are the unit's. No token of
        either vocabulary goes on over a space that follows another character,
        so units that don't end with white space are encoded many at a time
        and cut by their bytes."""
        count, exact = np.zeros(len(units), np.int64), np.ones(len(units), bool)
        parts: list[tuple[int, np.ndarray]] = []  # (first unit, ids of it and those after it)
        alone = [k for k, u in enumerate(units) if u[-1].isspace()]
        at, edges = 0, [*alone, len(units)]
        texts, members = [], []
        for edge in edges:  # runs of units between those that stay alone
            lo = at
            while lo < edge:
                hi, size = lo, 0
                while hi < edge and size < _JOINED:
                    size += len(units[hi])
                    hi += 1
                texts.append("".join(units[lo:hi]))
                members.append((lo, hi))
                lo = hi
            if edge < len(units):
                texts.append(units[edge])
                members.append((edge, edge + 1))
            at = edge + 1
        for (lo, hi), text, ids in zip(members, texts, self._vocabulary.encode(texts)):
            if self._exact(ids, text):
                ids = np.array(ids, np.int64)
                ends = np.cumsum([len(u.encode()) for u in units[lo:hi]])
                count[lo:hi] = np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right"), prepend=0)
                parts.append((lo, ids))
                continue
            for k, own in zip(range(lo, hi), self._vocabulary.encode(units[lo:hi])):
                exact[k] = self._exact(own, units[k])
                count[k] = len(own)
                parts.append((k, np.array(own, np.int64)))
        return np.concatenate([ids for _, ids in parts] or [np.zeros(0, np.int64)]), count, exact


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, stop)`` of the units of texts: a text's first unit lacks the
    space that goes in front, the others begin with one. They begin at spaces
    after an ASCII character other than white space, or between a non-ASCII
    and such a character; never at a text's last character."""
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:] - 1] = True
    space = np.flatnonzero((data[1:-1] == 32) & ~last[1 : len(data) - 1]) + 1
    solid = lambda b: (b > 32) & (b < 128)
    before, after = data[space - 1], data[space + 1]
    first = space[solid(before) | (before >= 128) & solid(after)]
    begins = np.zeros(len(data), bool)
    begins[first] = True
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    begins = np.flatnonzero(begins)
    return begins, np.append(begins[1:], len(data))[: len(begins)]


class Units:
    """Token ids of the units met so far for both sides, told apart by 64-bit
    hashes of what follows their space; each is encoded once while it is held.
    Beyond ``most`` units, those that one slice of text alone has held go."""

    def __init__(self, side_a: Side, side_b: Side, most: int = 250_000):
        self.side_a, self.side_b, self._most = side_a, side_b, most
        self._place: dict[int, int] = {}
        self._slices = np.zeros(0, np.int64)  # slices that held the unit
        self.exact = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32)] * 2
        self.count = [np.zeros(0, np.int64)] * 2
        self.begin = [np.zeros(0, np.int64)] * 2

    def _forget(self) -> None:
        kept = self._slices > 1
        if 2 * kept.sum() > self._most:
            kept[:] = False
        number = np.cumsum(kept) - 1
        self._place = {h: int(number[p]) for h, p in self._place.items() if kept[p]}
        self._slices, self.exact = np.zeros(int(kept.sum()), np.int64), self.exact[kept]
        for k in range(2):
            self.ids[k] = self.ids[k][np.repeat(kept, self.count[k])]  # ids lie in the order of the units
            self.count[k] = self.count[k][kept]
            self.begin[k] = np.cumsum(self.count[k]) - self.count[k]

    def numbers(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Number of the unit of each span of bytes."""
        if len(self._place) > self._most:
            self._forget()
        unit, distinct = pd.factorize(span_hashes(data, start, stop))
        hashes = distinct.tolist()
        place = [self._place.get(h, -1) for h in hashes]
        new = [k for k, n in enumerate(place) if n < 0]
        if new:
            first = np.zeros(len(distinct), np.int64)
            first[unit[::-1]] = np.arange(len(unit) - 1, -1, -1)
            raw = data.tobytes()
            texts = [" " + raw[lo:hi].decode() for lo, hi in zip(start[first[new]].tolist(), stop[first[new]].tolist())]
            exact = np.ones(len(new), bool)
            for k, side in enumerate((self.side_a, self.side_b)):
                ids, count, own = side.encode(texts)
                exact &= own
                self.ids[k] = np.concatenate((self.ids[k], ids.astype(np.int32)))
                self.count[k] = np.concatenate((self.count[k], count))
                self.begin[k] = np.cumsum(self.count[k]) - self.count[k]
            self.exact = np.concatenate((self.exact, exact))
            self._place.update(zip((hashes[k] for k in new), range(len(self._slices), len(self._slices) + len(new))))
            self._slices = np.concatenate((self._slices, np.zeros(len(new), np.int64)))
            place = [self._place[h] for h in hashes]
        place = np.array(place, np.int64)
        self._slices[place] += 1
        return place[unit]


def align_batch(units: Units, data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
    """One entry per text (UTF-8 bytes and offsets) under ``n_a, n_b,
    n_groups, n_links, groups`` and, as (codes, counts), ``pairs``."""
    side_a, side_b, rows = units.side_a, units.side_b, len(offsets) - 1
    start, stop = _units(data, offsets)
    row = np.searchsorted(offsets, start, side="right") - 1
    opens = offsets[row] == start  # the space in front is not in the data
    unit = units.numbers(data, np.where(opens, start, start + 1), stop)
    good = np.ones(rows, bool)
    good[row[~units.exact[unit]]] = False
    unit, row = unit[good[row]], row[good[row]]

    def laid_out(k: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = units.count[k][unit]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - units.begin[k][unit], n)
        own = units.ids[k][at].astype(np.int64)
        return own, np.cumsum(sizes[own]), np.repeat(row, n)

    a, end_a, row_a = laid_out(0, side_a.sizes)
    b, end_b, row_b = laid_out(1, side_b.sizes)
    left = pd.DataFrame({"at": end_a - side_a.sizes[a], "row": row_a, "a": np.arange(len(a))})
    right = pd.DataFrame({"at": end_b - side_b.sizes[b], "row": row_b, "b": np.arange(len(b))})
    from_a = pd.merge_asof(left, right, on="at", by="row")
    from_b = pd.merge_asof(right, left, on="at", by="row")
    # tokens that start together have found each other in both directions
    new = (right["at"].to_numpy() != left["at"].to_numpy()[from_b["a"].to_numpy()]) if len(b) else np.zeros(0, bool)
    link_a = np.concatenate((from_a["a"].to_numpy(), from_b["a"].to_numpy()[new]))
    link_b = np.concatenate((from_a["b"].to_numpy(), from_b["b"].to_numpy()[new]))
    link_row = row_a[link_a]

    ended = np.zeros((end_a[-1] if len(a) else 0) + 1, np.uint8)  # 1: a token of A ends here, 2: of B
    ended[end_a] = 1
    ended[end_b] += 2
    cut_a, cut_b = np.flatnonzero(ended[end_a] == 3), np.flatnonzero(ended[end_b] == 3)
    codes = len(side_b.bytes)
    found, times = np.unique(link_row * (len(side_a.bytes) * codes) + a[link_a] * codes + b[link_b], return_counts=True)
    in_row = found // (len(side_a.bytes) * codes)
    cuts = np.searchsorted(in_row, np.arange(rows + 1))
    found -= in_row * (len(side_a.bytes) * codes)

    per_row = lambda r: np.bincount(r, minlength=rows).tolist()
    return {"n_a": per_row(row_a), "n_b": per_row(row_b), "n_groups": per_row(row_a[cut_a]), "n_links": per_row(link_row),
            "groups": _groups(side_a, side_b, a, b, cut_a, cut_b, row_a, rows),
            "pairs": [(found[lo:hi], times[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]}


def _groups(side_a: Side, side_b: Side, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray,
            row_a: np.ndarray, rows: int) -> list[str]:
    """SHA-256 of each row's groups ``a1,a2|b1;a3|b2,b3`` ('' without tokens)."""
    # place of each token when the ids of A and of B take turns by groups
    before_a = np.concatenate(([0], cut_b + 1))[np.searchsorted(cut_a, np.arange(len(a)))]
    before_b = cut_a[np.searchsorted(cut_b, np.arange(len(b)))] + 1
    # numbers of the labels: A with ",", A with "|", B with ",", B with ";"
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[cut_a], last_b[cut_b] = True, True
    na, nb = len(side_a.bytes), len(side_b.bytes)
    order = np.zeros(len(a) + len(b), np.int64)
    place_a = np.arange(len(a)) + before_a
    order[place_a] = a + na * last_a
    order[np.arange(len(b)) + before_b] = b + nb * last_b + 2 * na
    labels = [*side_a.labels(b","), *side_a.labels(b"|"), *side_b.labels(b","), *side_b.labels(b";")]
    out = [""] * rows
    bounds = spans_of(row_a)
    begins = [*place_a[bounds[:-1]].tolist(), len(order)] if len(a) else [0]
    for k, r in enumerate(row_a[bounds[:-1]].tolist() if len(a) else []):
        text = b"".join(map(labels.__getitem__, order[begins[k] : begins[k + 1]].tolist()))
        out[r] = hashlib.sha256(text[:-1]).hexdigest()
    return out


_UNITS: dict[tuple[str, str], Units] = {}


def both_sides(path_a: str, path_b: str) -> Units:
    """Both vocabularies, read once per worker process."""
    if (path_a, path_b) not in _UNITS:
        _UNITS[path_a, path_b] = Units(Side(BytePairs(path_a)), Side(Pieces(path_b)))
    return _UNITS[path_a, path_b]


def align_documents(docs: DataFrame, path_a: str, path_b: str, turn_pairs: int = 2_000_000) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256`` of every row, its text encoded whole by the byte-level
    vocabulary A and the SentencePiece vocabulary B.

    A text that is null or empty, or whose joined token bytes of either side
    differ from a space and the text, has no tokens: zeros and ''. Repeated
    rows each count, also in the corpus-wide counts of linked ids; a null id
    stays null; other columns are ignored; an empty table gives no rows.

    The rows of one document and distinct pair of ids are written once to the
    checkpoint folder (a job runs while the plan is built). The counts of
    pairs are at most as many as pairs of ids; they are joined back in turns
    of ``turn_pairs``, each a broadcast of that size at most, so neither a
    very common pair nor the counts are shuffled with the documents.
    """
    both = both_sides(path_a, path_b)
    ids_b, most = len(both.side_b.bytes), len(both.side_a.bytes) * len(both.side_b.bytes)
    code = "int" if most < 2**31 else "bigint"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        units = both_sides(path_a, path_b)
        row = TaskContext.get().partitionId() << 36
        kind = pa.int32() if code == "int" else pa.int64()
        for batch in batches:
            ids = batch.column("doc_id")
            for begin, end, data, offsets in byte_slices(batch.column("text"), 4096, _SLICE):
                got = align_batch(units, data, offsets)
                pairs = got.pop("pairs")
                sizes = np.cumsum([0, *(len(p) for p, _ in pairs)])
                lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([p[k] for p in pairs]), t))
                         for k, t in ((0, kind), (1, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + end - begin), pa.int64()), ids.slice(begin, end - begin),
                     *(pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                     pa.array(got["groups"], pa.string()), *lists],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                row += end - begin

    found = staged(rows.mapInArrow(aligned, f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                            f"groups_sha256 string, pairs array<{code}>, times array<bigint>"), "align-rows")
    links = (found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
             .select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")))
    counts = links.groupBy("pair").agg(F.sum("times").alias("total"))
    highest = counts.groupBy((F.col("pair") % ids_b).alias("b")).agg(F.max("total").alias("highest"))
    counts = staged(counts.join(highest, F.col("pair") % ids_b == F.col("b"))
                    .select("pair", "total", (F.col("total") == F.col("highest")).alias("best")), "align-counts")
    turns = max(1, -(-counts.count() // turn_pairs))
    looked_up = None
    for turn in range(turns):
        own = lambda df: df.where(F.col("pair") % turns == turn)  # noqa: B023, E731
        part = (own(links).join(F.broadcast(own(counts)), "pair").groupBy("row")
                .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                     F.sum(F.col("times") * F.col("total")).alias("count_sum")))
        looked_up = part if looked_up is None else looked_up.unionAll(part)
    if turns > 1:
        looked_up = looked_up.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return (found.drop("pairs", "times").join(looked_up, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                    F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))
