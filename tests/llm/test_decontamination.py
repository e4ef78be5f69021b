"""Benchmark passages: recall against brute force, paraphrases, and the SVD."""

import random
import re

import numpy as np
import pyarrow as pa

from ampere.llm import decontamination as dec
from ampere.llm.words import word_hashes, slices

from llm_tables import SMALL, documents


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def test_every_planted_passage_and_nothing_else(spark, small, texts):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r.item_id: " ".join(words(r.text)) for r in bench.collect()}
    wanted = {(d, i) for d, t in texts.items() for i, item in items.items() if item in " ".join(words(t))}
    rows = dec.find_leaks(small, bench).collect()
    assert wanted and {(r.doc_id, r.item_id) for r in rows if r.lcs == 1.0} == wanted
    assert {(r.doc_id, r.item_id) for r in rows} == wanted


def test_paraphrases_and_clean_texts(spark):
    rng = random.Random(5)
    lexicon = [f"term{k}" for k in range(4000)]
    common = ["the", "of", "and", "to", "in"]

    def text(n):
        return [rng.choice(common) if rng.random() < 0.4 else rng.choice(lexicon) for _ in range(n)]

    items = [text(rng.randrange(18, 60)) for _ in range(30)]
    docs, planted = [], set()
    for d in range(200):
        body = text(rng.randrange(50, 400))
        if d % 4 == 0:
            i = rng.randrange(len(items))
            leak = [w if rng.random() > 0.12 else rng.choice(lexicon) for w in items[i]]
            at = rng.randrange(len(body))
            body[at:at] = leak
            planted.add((d, i))
        docs.append((d, " ".join(body).upper()))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    params = [dec.RetrievalParams(), dec.RetrievalParams(passages_at_once=7), dec.RetrievalParams(rank=12, oversample=8, cosine=0.2)]
    for p in params:
        got = {(r.doc_id, r.item_id) for r in dec.find_leaks(documents(spark, docs), bench, p).collect()}
        assert got <= planted and (len(got) >= 0.95 * len(planted) or p.rank == 12)


def test_a_passage_that_most_documents_hold(spark):
    rng = random.Random(8)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    docs = [(d, " ".join(f"w{rng.randrange(9000)}" for _ in range(80)) + (f" {passage} end" if d % 3 else "")) for d in range(90)]
    bench = spark.createDataFrame([(1, passage), (2, "unrelated words that nobody ever wrote anywhere in these documents at all")], "item_id long, text string")
    rows = dec.find_leaks(documents(spark, docs), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(d, 1) for d in range(90) if d % 3]


def test_svd_equals_dense(spark):
    rng = np.random.default_rng(2)
    dense = (rng.random((60, 25)) < 0.3) * rng.random((60, 25))
    rows = [([int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for r in dense]
    df = spark.createDataFrame(rows, "places array<long>, weights array<float>").repartition(4)
    basis, values = dec.randomised_svd(df, 25, rank=25, oversample=5)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, s, rtol=1e-3)
    basis, values = dec.randomised_svd(df, 25, rank=6, oversample=12, power=2)
    assert basis.shape == (25, 6) and np.allclose(values, s[:6], rtol=2e-2)
    assert np.abs(np.abs((basis * vt[:6].T).sum(axis=0)) - 1).max() < 0.05


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert dec.Lcs(np.array(a, np.uint64)).length(b) == table[-1][-1]


def test_word_arrays_equal_a_pattern():
    texts = ["the quick brown", None, "", "é naïve—word ‘x’ a_b 12", "x" * 200 + " " + "x" * 201, "«a» 漢字。かな 1", "end", "start"]
    found, alone = [], []
    for begin, end, h, row in slices(pa.array(texts)):
        for i in range(begin, end):
            found.append(h[row == i - begin].tolist())
    pattern = re.compile(r"\w+")
    for t, hs in zip(texts, found):
        own = pattern.findall(t or "")
        assert len(own) == len(hs)
        alone += zip(own, hs)
    assert len(set(alone)) == len({w for w, _ in alone}) == len({h for _, h in alone})
    assert len(word_hashes(np.zeros(0, np.uint8), np.array([0]))[0]) == 0


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(0, None), (1, ""), (2, "the quick brown fox jumps over a lazy dog and runs far away home"), (2, "x"),
                                   (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
                                   (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
                                   (None, "some item without an id that is in no document at all here")],
                                  "item_id long, text string")
    more = documents(spark, [(50, "we saw Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron there")] * 2)
    docs = odd.select("doc_id", "text").unionAll(more.select("doc_id", "text"))
    rows = dec.find_leaks(docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(50, 3)] * 2
    assert dec.find_leaks(empty, bench).count() == 0 and dec.find_leaks(odd, bench.limit(0)).count() == 0
    kept = dec.drop_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_each_row_goes_or_stays_by_its_own_text(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    bench = spark.createDataFrame([(3, passage)], "item_id long, text string")
    leak, clean = f"we saw {passage} there", "a clean text of quite ordinary words that shares nothing with the other one"
    rows = [(1, leak), (1, clean), (None, leak), (None, clean), (None, None), (2, clean), (2, clean), (7, "")]
    kept = dec.drop_leaks(documents(spark, rows), bench).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted((r for r in rows if r[1] != leak), key=str)


def test_more_passages_than_the_space_has_dimensions(spark):
    """Recall of verbatim passages where the rank truncates the space."""
    rng = random.Random(12)
    lexicon = [f"w{k}" for k in range(4000)]
    items = [[rng.choice(lexicon) for _ in range(rng.randrange(12, 45))] for _ in range(300)]
    docs, planted = [], set()
    for d in range(150):
        body = [rng.choice(lexicon) for _ in range(120)]
        for i in (2 * d, 2 * d + 1):
            at = rng.randrange(len(body))
            body[at:at] = items[i]
            planted.add((d, i))
        docs.append((d, " ".join(body)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.find_leaks(documents(spark, docs), bench, dec.RetrievalParams(rank=64)).collect()}
    lost = {p for p in planted - got}
    assert got <= planted and len(lost) <= 0.1 * len(planted), len(lost)
