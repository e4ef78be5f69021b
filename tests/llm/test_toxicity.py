"""The toxicity classifier: held-out accuracy, and what it must not see."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampere.llm import toxicity

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_accuracy_without_held_out_labels(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = toxicity.score_documents(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(rows) == docs.count()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    right = np.mean([r.predicted == toxic[r.doc_id] for r in held])
    assert right > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    # labels of held-out rows change nothing
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score_documents(docs, turned).select("doc_id", "score").collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in rows}, abs=1e-9)


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    space = toxicity.NgramSpace()
    text = "Some Text with words " * 40
    whole = np.unique(np.concatenate(list(space.blocks(text))))
    monkeypatch.setattr(toxicity, "_BLOCK", 64)
    parts = np.unique(np.concatenate(list(space.blocks(text))))
    assert np.array_equal(whole, parts)
    scratch = np.zeros(space.size, bool)
    assert np.array_equal(np.sort(space.present(text, scratch)), whole) and not scratch.any()


def test_odd_rows(spark, odd, empty):
    words = ["fine calm words here", "awful nasty words here"]
    labelled = odd.select("doc_id", "text").unionAll(
        spark.createDataFrame([(100 + i, f"{words[i % 2]} {i}") for i in range(60)], "doc_id long, text string"))
    labels = spark.createDataFrame([(100 + i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (101, 1, None), (999, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(labelled, labels).collect()
    assert len(rows) == labelled.count() and all(r.score is not None for r in rows)
    right = [r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id >= 100]
    assert all(right)
    assert toxicity.score_documents(empty, labels).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.predicted for r in toxicity.score_documents(odd, none).collect()} == {0}
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns
    assert {r.score for r in toxicity.drop_toxic(odd, labels.limit(0)).collect()} == {"kept"}
