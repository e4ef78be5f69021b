"""The chosen-path join against all pairs."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from ampere.llm import ngram_join
from ampere.llm.ngram_join import JoinParams, shingles
from ampere.llm.tables import connected_components

from llm_tables import documents


def brute(texts, threshold=0.8):
    """(class id, links, copies) per id, from all pairs of distinct shingle sets."""
    sets = {i: frozenset(shingles(t).tolist()) for i, t in texts.items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    copies = collections.Counter(sets.values())
    reps = sorted(first.values())
    parent = {i: i for i in reps}
    links = collections.Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(reps):
        for j in reps[:x]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                ri, rj = root(i), root(j)
                parent[max(ri, rj)] = min(ri, rj)
    return {i: (root(first[s]), links[first[s]], copies[s]) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in df.collect()}


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_small_table(small, texts):
    assert result(ngram_join.near_duplicates(small)) == brute(texts)


def test_groups_of_copies_and_shared_passages(spark):
    rng = random.Random(3)
    base = [f"b{rng.randrange(5000)}" for _ in range(120)]
    hot = " ".join(f"h{k}" for k in range(40))
    texts = {}
    for i in range(150):  # one large group of near copies: some pairs link, some do not
        texts[i] = edited(base, rng, rng.randrange(4))
    for i in range(150, 260):  # unrelated texts around one passage that all share
        texts[i] = " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + " " + hot
    for i in range(260, 300):
        texts[i] = " ".join(base)  # exact copies
    texts |= {300: "", 301: "!!", 302: "just three words", 303: "Just three, words"}
    df = documents(spark, list(texts.items()))
    # small limits, so that buckets are split and dealt in blocks
    params = JoinParams(recall=0.9999, small=4, sketch_block=16, block=8)
    assert result(ngram_join.near_duplicates(df, params)) == brute(texts)


def test_odd_rows(odd, empty, texts):
    got = ngram_join.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.class_id, r.n_copies))
    assert by_id[0] == by_id[1] == by_id[2] == {(0, 3)}  # no words
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(set(rows)) and {None, 0} <= {i for i, _ in rows} and not {1, 2} & {i for i, _ in rows}


def test_rows_that_share_an_id_or_have_none(spark):
    t, u = ("the same words in this text as in the other one " * 3, "quite another text that nobody else has ever written down here")
    rows = [(1, t), (9, t), (9, u), (10, u + " " + u), (None, t), (None, u + " x"), (None, "only here: a text without an id and without copies"),
            (None, "only here: a text without an id and without copies"), (4, None), (4, "")]
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one_of_each(documents(spark, rows)).collect()), key=str)
    assert kept.count((1, t)) == 1 and (9, t) not in kept and (None, t) not in kept
    assert (9, u) in kept and kept.count((None, rows[6][1])) == 1
    assert sum(i == 4 for i, _ in kept) == 1
    texts = [x or "" for _, x in kept]
    of_row = brute({k: x or "" for k, (_, x) in enumerate(rows)})
    assert len({of_row[[x or "" for _, x in rows].index(x)][0] for x in texts}) == len(texts) == len({c for c, _, _ in of_row.values()})


def test_buckets_that_split_lose_no_link(spark):
    """Production parameters but for the size from which buckets split."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in rows.select("doc_id", "text").collect()}
    assert result(ngram_join.near_duplicates(rows, JoinParams(small=2))) == brute(texts)


def test_runs_follow_the_recall():
    assert JoinParams(recall=0.9).runs < JoinParams(recall=0.99).runs < JoinParams(recall=0.9999).runs


def test_sets_of_the_same_similarity_meet_as_often_as_planned():
    rng = np.random.default_rng(1)
    p = JoinParams(levels=1)
    met = 0
    roots = ngram_join.seeds64(1, 5)
    for _ in range(400):
        both = rng.integers(0, 2**63, 180, dtype=np.uint64)
        sets = [np.unique(np.concatenate((both, rng.integers(0, 2**63, 20, dtype=np.uint64)))) for _ in range(2)]
        limit = np.uint64(2.0**64 / (p.threshold * 200))
        a, b = (set(ngram_join.split(s, roots, limit)[1].tolist()) for s in sets)
        met += bool(a & b)
    assert 0.58 < met / 400 < 0.78  # 1 - exp(-0.9 / 0.8) = 0.675


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = connected_components(edges).collect()
    assert len(rows) == 201 and {r.component for r in rows} == {0}
    assert connected_components(edges.limit(0)).count() == 0


def test_sql_twin(spark):
    from oracle_compare import compare

    from ampere.llm import ORACLES, QUERIES

    r = compare(spark, "op4", QUERIES["op4_chosen_path_join"], ORACLES["op4_chosen_path_join"], "/root/testdata/sf0.01")
    assert r["status"] == "match", r
