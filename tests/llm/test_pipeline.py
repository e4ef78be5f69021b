"""The pipeline's stages on the smallest corpus, each against its own input."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from llm_tables import SMALL
from tokenizers import Tokenizer

from ampere.llm import decontamination, ngram_join, toxicity
from ampere.llm.queries import word_vocabulary
from ampere.llm.tables import staged


@pytest.fixture(scope="module")
def steps(spark, small):
    out = [small]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SMALL), f"test-{name}"))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_order_and_columns(steps, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert all(df.columns == small.columns for df in steps[:-1])


def test_filters_decide_as_their_operators(spark, steps):
    docs, clean, single, safe, redacted, pieces = steps
    labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids(clean) == {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 0").collect()}
    assert ids(single) == {r.class_id for r in ngram_join.near_duplicates(clean).collect()}
    assert ids(safe) == ids(single) - {r.doc_id for r in decontamination.find_leaks(single, bench).collect()}
    assert ids(redacted) == ids(safe) == ids(pieces) and ids(safe)


def test_pieces_are_the_redacted_texts(steps):
    tok = Tokenizer.from_file(word_vocabulary())
    tok.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    for r in steps[5].collect():
        all_ids = np.array([*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert r.doc_tokens == len(all_ids) and r.ids_crc32 == zlib.crc32(all_ids[r.start : r.start + r.length].tobytes())


def test_run_equals_the_stages(spark, steps):
    run = corpus_pipeline.run(spark, SMALL)
    assert sorted(run.collect()) == sorted(steps[5].collect())


def test_odd_and_empty_tables(spark, odd, empty):
    """Nulls, shared and missing ids, repeated rows, long texts and clashing
    columns pass all stages, among enough others to learn from; so does an
    empty table."""
    extra = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    strange = odd.withColumn("doc_id", odd.doc_id + 1_000_000)
    docs = base.select(["doc_id", "text", "lang", "source", "n_chars"]).unionByName(strange, allowMissingColumns=True)
    out = staged(docs, "test-odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, out, SMALL), f"test-odd-{name}")
        assert sorted(out.columns) == sorted(docs.columns)
    rows = [r for r in out.collect() if r.doc_id is None or r.doc_id >= 1_000_000]
    texts = [r.text for r in rows]
    # one row without words, one of the repeated rows, both texts of the shared id and the one without an id
    assert sum(not (t or "").strip() for t in texts) <= 1 and texts.count("one two three four five") == 1
    assert "another text with id three" in texts and "no id at all" in texts
    assert all(getattr(r, c) == "kept" for r in rows for c in extra)
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, SMALL).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and len(pieces) >= out.count()
    nothing = empty
    for name, stage in corpus_pipeline.STAGES:
        nothing = staged(stage(spark, nothing, SMALL), f"test-empty-{name}")
        assert nothing.count() == 0
