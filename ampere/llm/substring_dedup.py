"""Substring deduplication by content-defined chunking.

A gear rolling hash (a shift and a table look-up per character) cuts texts
where its top bits are zero, so cuts depend on the last 16 characters alone
and move with the text when something is inserted before them. Chunks that
several documents hold are found by their digest; runs of adjacent repeated
chunks are extended, character by character, over the parts of chunks at
either end that the documents share, and become spans.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampere.llm.tables import codepoints, numbered, passing, seeds64, staged

#: the gear table: 2^16 fixed random numbers, one for each low half of a code point
_GEAR = (seeds64(1 << 16, 3) >> np.uint64(48)).astype(np.uint16)
_REACH = 16  # characters that a 16-bit gear hash remembers


@dataclass(frozen=True)
class ChunkParams:
    """Chunks end where ``bits`` top bits of the hash are zero (every 2^bits
    characters), at ``least`` characters or more and ``most`` or fewer. A run
    of repeated chunks with its extensions counts from ``span`` characters on,
    or if it is the whole text."""

    bits: int = 5
    least: int = 16
    most: int = 256
    span: int = 96


#: documents to compare with: the first ones that share so many characters beside a chunk
_RUNGS = (0, 16, 48, 128)
_GAIN = 16  # characters that another than the chunk's first document must share beyond it
_BACK = 128  # characters before the chunk in front of a run that are compared as well


def gear_hashes(points: np.ndarray) -> np.ndarray:
    """Gear hash after each character: h = (h << 1) + gear[c], in 16 bits.
    Doubling: the hash over 2n characters joins two over n."""
    h = _GEAR[points & np.uint32(0xFFFF)]
    reach = 1
    while reach < _REACH:
        shifted = np.zeros_like(h)
        shifted[reach:] = h[:-reach] << np.uint16(reach) if reach < len(h) else 0
        h = h + shifted
        reach *= 2
    return h


def cuts(points: np.ndarray, p: ChunkParams) -> list[int]:
    """Ends of the chunks of a text, the last being its length."""
    n = len(points)
    out, last, at = [], 0, 0
    for begin in range(0, n, 1 << 20):  # long texts in parts that overlap by the hash's reach
        part = points[max(0, begin - _REACH) : begin + (1 << 20)]
        ends = np.flatnonzero(gear_hashes(part) < np.uint16(1 << (16 - p.bits))) + max(0, begin - _REACH) + 1
        for end in ends[ends > begin].tolist():
            if end - last < p.least:
                continue
            while end - last > p.most:
                last += p.most
                out.append(last)
            if end - last >= p.least:
                out.append(end)
                last = end
    while n - last > p.most:
        last += p.most
        out.append(last)
    if n > last:
        out.append(n)
    return out


def chunk_table(docs: DataFrame, p: ChunkParams) -> DataFrame:
    """``(doc_id, start, length, prev, next, d1, d2)``: all chunks of all whole
    texts with their 128-bit digest; positions in code points; ``prev`` and
    ``next``: lengths of the chunks before and after (0: none)."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, starts, lengths, prevs, nexts, digests = [], [], [], [], [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if not text:
                        continue
                    points = codepoints(text)
                    ends = cuts(points, p)
                    begins = [0, *ends[:-1]]
                    view = memoryview(points).cast("B")
                    digests += [xxhash.xxh3_128_digest(view[4 * b : 4 * e]) for b, e in zip(begins, ends)]
                    ids.append(np.full(len(ends), doc_id, np.int64))
                    starts.append(np.array(begins, np.int64))
                    sizes = np.diff([0, *ends])
                    lengths.append(sizes)
                    prevs.append(np.concatenate(([0], sizes[:-1])).astype(np.int32))
                    nexts.append(np.concatenate((sizes[1:], [0])).astype(np.int32))
                if ids:
                    d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, starts, lengths, prevs, nexts)]
                                                     + [pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())],
                                                     ["doc_id", "start", "length", "prev", "next", "d1", "d2"])

    return with_text(docs).mapInArrow(chunks, "doc_id long, start long, length long, prev int, next int, d1 long, d2 long")


def with_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")


def packed(docs: DataFrame) -> DataFrame:
    """``(doc_id, zipped)``: texts compressed one by one, for the shuffle."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.encode() for x in batch.column("text").to_pylist()]
            zipped = [len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(zipped, pa.binary())], ["doc_id", "zipped"])

    return with_text(docs).where("text <> ''").mapInArrow(pack, "doc_id long, zipped binary")


def contexts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``(doc_id, start, side, d1, d2, length, mine, context, whole)``: the text
    beside the chunks of ``places (doc_id, start, length, side, d1, d2, reach,
    mine)``, up to ``reach`` characters: before it and backwards (side 0) or
    after it (side 1); ``whole``: up to the border of the text. Places given
    twice count once."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(at, 64).to_pylist():
                    zipped = r["zipped"]
                    points = codepoints(pa.decompress(zipped[8:], int.from_bytes(zipped[:8], "little"), "zstd", asbytes=True).decode())
                    view = memoryview(points).cast("B")
                    mine = {(x["start"], x["side"]) for x in r["places"] if x["mine"]}
                    for x in r["places"]:
                        b, e = x["start"], x["start"] + x["length"]
                        if x["mine"] or e > len(points):
                            continue
                        digest = np.frombuffer(xxhash.xxh3_128_digest(view[4 * b : 4 * e]), np.int64)
                        if digest[0] != x["d1"] or digest[1] != x["d2"]:  # another text of this id
                            continue
                        left, room = x["side"] == 0, b if x["side"] == 0 else len(points) - e
                        beside = points[max(0, b - x["reach"]) : b][::-1] if left else points[e : e + x["reach"]]
                        rows.append((r["doc_id"], b, x["side"], x["d1"], x["d2"], x["length"], (b, x["side"]) in mine,
                                     beside.tobytes().decode("utf-32-le", "replace"), len(beside) == room))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["doc_id", "start", "side", "d1", "d2", "length", "mine", "context", "whole"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_()]
    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "side", "d1", "d2", "reach", "mine")).alias("places"))
    return packed(docs).join(by_doc.hint("merge"), "doc_id").mapInArrow(
        cut, "doc_id long, start long, side int, d1 long, d2 long, length long, mine boolean, context string, whole boolean")


def shared_lengths(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``shared``, the length of the common beginning of
    ``context`` and ``other``, in place of those two."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("context").to_pylist(), batch.column("other").to_pylist())
            shared = pa.array([(len(os.path.commonprefix(x)), len(x[0])) for x in both], pa.list_(pa.int64(), 2)).flatten()
            out = batch.drop_columns(["context", "other", "whole"])
            whole = np.asarray(batch.column("whole").to_numpy(zero_copy_only=False)) & (np.asarray(shared[::2]) == np.asarray(shared[1::2]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.asarray(shared[::2])), pa.array(whole)], [*out.schema.names, "shared", "whole"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name not in ("context", "other", "whole")]
    return pairs.mapInArrow(measure, ", ".join([*kept, "shared long", "whole boolean"]))


#: a key with more than this share of all rows is joined by broadcast, so that no task gets them all
_HOT_SHARE = 1 / 20_000


def spread_join(rows: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``right``, a staged table of one row per key with
    ``n``, the key's rows. Keys with more than one in 20,000 of all rows (so at
    most 20,000 keys) are broadcast and their rows stay where they are; the
    others are dealt by a merge join."""
    total = right.agg(F.sum("n")).first()[0] or 0
    hot, others = right.where(F.col("n") > total * _HOT_SHARE).drop("n"), right.where(F.col("n") <= total * _HOT_SHARE).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(others.hint("merge"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def extensions(docs: DataFrame, repeated: DataFrame, runs: DataFrame, params: ChunkParams) -> DataFrame:
    """``(doc_id, start, end, last, copy_of)``: what the ends of ``runs`` share
    with a document of smaller id that holds the same chunk, beyond the chunk.

    Of the documents compared, the one that shares the most counts; ties and
    less than 16 characters more go to the first document of the chunk. After
    a chunk both texts are cut alike, so less than one more chunk can be
    shared; before it, cuts may differ for a while: 128 characters before the
    next chunk are compared as well.
    """
    edge = lambda side, x, reach: F.struct(F.lit(side).alias("side"), x["start"].alias("start"), x["length"].alias("length"), x["d1"].alias("d1"),
                                           x["d2"].alias("d2"), reach.cast("int").alias("reach"))
    edges = runs.select("doc_id", F.explode(F.array(
        edge(0, F.col("head"), F.when(F.col("head.start") > 0, F.col("head.prev") + _BACK).otherwise(F.lit(0))),
        edge(1, F.col("tail"), F.col("tail.next")))).alias("e")).select("doc_id", "e.*", F.lit(True).alias("mine")).where("reach > 0")
    # one row per chunk: how far each side is looked at (0: not at all)
    reach = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("reach"))), F.lit(0))
    sought = edges.groupBy("d1", "d2").agg(F.array(*[F.struct(F.lit(k).alias("side"), reach(k).alias("reach")) for k in (0, 1)]).alias("sides"))
    counts = repeated.groupBy("d1", "d2").agg(F.count("*").alias("n"))
    sought = staged(sought.join(counts.hint("merge"), ["d1", "d2"]), "chunk-sought")
    places = spread_join(repeated.select("doc_id", "start", "length", "d1", "d2"), sought, ["d1", "d2"])
    places = places.select("doc_id", "start", "length", "d1", "d2", F.inline("sides")).where("reach > 0").withColumn("mine", F.lit(False))
    beside = staged(contexts(docs, places.unionByName(edges)), "chunk-contexts")
    # the first place of each chunk with these 0, 16, ... characters beside it
    rungs = F.filter(F.array(*map(F.lit, _RUNGS)), lambda k: k <= F.char_length("context"))
    key = lambda k: F.xxhash64("d2", "side", k, F.substring(F.col("context"), F.lit(1), k))
    place = ["doc_id", "start", "side", "d1", "d2"]
    steps = beside.select(*place, "mine", F.explode(F.transform(rungs, lambda k: F.struct(k.alias("k"), key(k).alias("key")))).alias("s"))
    steps = steps.select(*place, "mine", "s.k", "s.key")
    least = steps.groupBy("d1", "key").agg(F.min(F.struct("doc_id", "start")).alias("source"), F.count("*").alias("n"))
    least = staged(least.select("d1", "key", F.col("source.doc_id").alias("source_doc"), F.col("source.start").alias("source_start"), "n"), "chunk-sources")
    best = spread_join(steps.where("mine").drop("mine"), least, ["d1", "key"]).where("source_doc < doc_id")
    best = best.groupBy(*place, "source_doc", "source_start").agg(F.min("k").alias("k"))
    ours = beside.where("mine").groupBy(*place).agg(F.min(F.struct("length", "context", "whole")).alias("c"))
    other = beside.groupBy(*place).agg(F.min("context").alias("other"))  # once for repeated rows of one id
    other = other.withColumnsRenamed({"doc_id": "source_doc", "start": "source_start"})
    pairs = best.join(ours.hint("merge"), place).select(*place, "k", "source_doc", "source_start", "c.*")
    pairs = pairs.join(other.hint("merge"), ["source_doc", "source_start", "side", "d1", "d2"])
    pairs = pairs.select("doc_id", "start", "length", "side", "source_doc", "k", "context", "other", "whole")
    gain = F.col("shared") - F.when(F.col("k") > 0, F.lit(_GAIN)).otherwise(F.lit(0))
    found = shared_lengths(pairs).groupBy("doc_id", "start", "length", "side").agg(
        F.max(F.struct(gain.alias("gain"), (-F.col("source_doc")).alias("less"), "shared", "whole")).alias("f"))
    found = found.select("doc_id", "start", "length", "side", (-F.col("f.less")).alias("source_doc"), "f.shared", "f.whole").where("shared > 0")
    after = F.col("start") + F.col("length")
    return found.select("doc_id", F.when(F.col("side") == 0, F.col("start") - F.col("shared")).otherwise(after).alias("start"),
                        F.when(F.col("side") == 0, F.col("start")).otherwise(after + F.col("shared")).alias("end"),
                        ((F.col("side") == 1) & F.col("whole")).alias("last"), F.array("source_doc").alias("copy_of"))


def repeated_spans(docs: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """``doc_id, start, length, chunks, copy_of``: spans (code points) that a
    document repeats from documents with smaller ids, which keep them: runs of
    repeated chunks and what their ends share beyond, ``span`` characters or
    more, and whole texts of any length.

    ``chunks``: the number of whole chunks; ``copy_of``: sorted ids of the
    first documents of the span's chunks and of those its ends were compared
    with. Repeats inside one document are left alone. Rows without id or text
    have no spans; repeated rows of one id count as one document; other
    columns are ignored; an empty table gives no spans.
    """
    with passing():
        chunks = staged(chunk_table(docs, params), "chunks")
        first = chunks.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"))
        first = staged(first.where("first_doc <> last_doc").select("d1", "d2", "first_doc", "n"), "chunk-firsts")
        repeated = staged(spread_join(chunks, first, ["d1", "d2"]), "repeated-chunks", lasting=True)
    again = repeated.where("doc_id <> first_doc").groupBy("doc_id", "start").agg(
        F.min(F.struct((-F.col("length")).alias("less"), "first_doc", "prev", "next", "d1", "d2")).alias("c"))
    again = again.select("doc_id", "start", (-F.col("c.less")).alias("length"), "c.first_doc", "c.prev", "c.next", "c.d1", "c.d2")
    by_place = Window.partitionBy("doc_id").orderBy("start")
    gap = F.coalesce(F.lag(F.col("start") + F.col("length")).over(by_place) != F.col("start"), F.lit(True))
    run = F.sum(gap.cast("int")).over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    chunk = F.struct("start", "length", "prev", "next", "d1", "d2")
    runs = staged(again.withColumn("run", run).groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.count("*").alias("chunks"),
        F.collect_set("first_doc").alias("copy_of"), F.min(chunk).alias("head"), F.max(chunk).alias("tail")), "chunk-runs")
    parts = runs.select("doc_id", "start", "end", (F.col("tail.next") == 0).alias("last"), "copy_of", "chunks").unionByName(
        extensions(docs, repeated, runs, params).withColumn("chunks", F.lit(0).cast("bigint")))
    # runs and extensions that touch or overlap are one span
    by_place = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("gap", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    spans = parts.withColumn("span", F.sum("gap").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("last").alias("last"), F.sum("chunks").alias("chunks"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("copy_of")))).alias("copy_of"))
    length = F.col("end") - F.col("start")
    return spans.where((length >= params.span) | (F.col("start") == 0) & F.col("last")).select(
        "doc_id", "start", length.alias("length"), "chunks", "copy_of")


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` less its sorted, disjoint ``spans`` (array of start, length)."""
    ends = F.transform(spans, lambda s: s["start"] + s["length"])
    begins = F.concat(F.array(F.lit(0).cast("bigint")), ends)
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("bigint")))
    pieces = F.transform(F.arrays_zip(begins.alias("b"), stops.alias("e")),
                         lambda x: F.substring(text, (x["b"] + 1).cast("int"), (x["e"] - x["b"]).cast("int")))
    return F.array_join(pieces, "")


def deduplicate(docs: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``; all rows and columns
    stay. A document is an id with a text: rows that repeat both are cut
    alike, two texts of one id are two documents, and each row with a null id
    is one, after all others (equal ids by their texts)."""
    text_hash = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = numbered(docs, "dedup-docs", [F.col("doc_id").asc_nulls_last(), text_hash])
    known = rows.select("row", F.col("doc.doc_id").alias("id"), F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("hash"))
    # rows without an id stand for themselves
    known = known.withColumn("alone", F.when(F.col("id").isNull(), F.col("row")))
    firsts = known.groupBy("id", "hash", "alone").agg(F.min("row").alias("first"))
    same = firsts["id"].eqNullSafe(known["id"]) & (firsts["hash"] == known["hash"]) & firsts["alone"].eqNullSafe(known["alone"])
    place = staged(known.join(firsts, same).select(known["row"], "first"), "dedup-places")
    texts = rows.join(place.where("row = first").select("row"), "row", "left_semi")
    spans = repeated_spans(texts.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), params)
    spans = spans.groupBy(F.col("doc_id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    joined = rows.join(place.join(spans, "first"), "row", "left")
    text = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(without_spans(F.col("doc.text"), F.col("spans")))
    return joined.withColumn("doc", F.col("doc").withField("text", text)).select("doc.*")
