"""Packing: exact round trip through the public tokenizer, and the curve."""

import collections
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ampere.llm import packing
from ampere.llm.queries import word_vocabulary
from ampere.llm.words import byte_slices


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(word_vocabulary())
    t.encode_special_tokens = True
    return t


def assert_packed(rows, texts, tok, capacity):
    """``texts``: (doc_id, text) rows."""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        used = 0
        for offset, length in sorted(places):
            assert offset == used and length > 0
            used += length
        assert used <= capacity
    wanted = collections.Counter()
    got = collections.Counter()
    for doc_id, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        wanted[doc_id, len(ids)] += len(ids)
        if sum(d == doc_id for d, _ in texts) == 1:
            at = 0
            for start, length, crc, total in sorted(pieces[doc_id]):
                assert start == at and total == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
                at += length
            assert at == len(ids)
    for doc_id, ps in pieces.items():
        for _, length, _, total in ps:
            got[doc_id, total] += length
    assert got == wanted
    return sequences


def test_documents(spark, small, texts, tok):
    rows = packing.pack_documents(small, word_vocabulary()).collect()
    sequences = assert_packed(rows, list(texts.items()), tok, 4096)
    assert len(sequences) == -(-sum(r.length for r in rows) // 4096)  # one partition: no padding but at the end


def test_partitions_and_odd_rows(spark, odd, empty, tok):
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows = packing.pack_documents(odd, word_vocabulary(), capacity=64, partition_bytes=50_000).collect()
    assert_packed(rows, texts, tok, 64)
    assert packing.pack_documents(empty, word_vocabulary()).count() == 0


def test_hilbert_steps_are_unit_steps():
    side = 8
    cells = np.array(list(itertools.product(range(side), repeat=3)))
    keys = packing.hilbert_keys((cells + 0.5) / side * 2 - 1, reach=1.0, bits=3)
    assert sorted(keys.tolist()) == list(range(side**3))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_points_depend_on_the_text_alone():
    texts = ["some words here", None, "", "other words there " * 50, "some words here"]
    points = packing.project_batch(pa.array(texts))
    alone = np.concatenate([packing.project_batch(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(points, alone) and np.array_equal(points[0], points[4]) and not points[1:3].any()


def test_cached_tokenizer_equals_the_tokenizer(tok):
    texts = ["Hello, World's  end now", "it's a\x1cb", "<|endoftext|> x", "naïve café, ①② e\u0301. x", "", "a,b ,c , d", "x'%s 'S! don't,stop",
             "A.B.C %%% and%%%, \u00a0nbsp\u2003em…, (é) «q» 3.14 ab12c", "tail", " ", "head"] * 2
    cached = packing.CachedTokenizer(word_vocabulary(), most=3)
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
    for rows in (1, 3, 100):
        got = []
        for _, _, data, offsets in byte_slices(pa.array(texts), rows):
            ids, bounds = cached.encode(data, offsets)
            got += [ids[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]
        assert [g.tolist() for g in got] == [w.tolist() for w in want]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'AZ., !%s\t\n09é\u0301ñ…ß"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_cached_tokenizer_on_any_text(tok, texts):
    cached = packing.tokenizer(word_vocabulary())
    got = []
    for _, _, data, offsets in byte_slices(pa.array(texts, pa.string())):
        ids, bounds = cached.encode(data, offsets)
        got += [ids[lo:hi].tolist() for lo, hi in zip(bounds[:-1], bounds[1:])]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
