"""Toxicity scores: a linear classifier over character n-grams whose features
are scaled by naive Bayes log-count ratios (Wang and Manning, 2012), trained
on labelled rows.

Training uses a bounded, documented sample of labelled rows (``max_rows``);
scoring covers every row and every character of its text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampere.llm.tables import codepoints, staged

#: code points handled at once, so that a very long text needs little memory
_BLOCK = 1 << 18


@dataclass(frozen=True)
class NgramSpace:
    """Hashed character n-grams of the lower-cased text between two spaces."""

    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 20

    @property
    def size(self) -> int:
        return 1 << self.bits

    def blocks(self, text: str | None) -> Iterator[np.ndarray]:
        """Feature numbers of all n-grams, block by block (with repeats)."""
        points = codepoints(f" {(text or '').lower()} ")
        points = np.where((points == 10) | (points == 9) | (points == 13), np.uint32(32), points)
        reach = max(self.orders) - 1
        for start in range(0, len(points), _BLOCK):
            part = points[start : start + _BLOCK + reach]
            own = min(_BLOCK, len(points) - start)
            h = np.zeros(len(part), dtype=np.uint32)
            for n in range(1, max(self.orders) + 1):
                if n > len(part):
                    break
                h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :]
                if n in self.orders:
                    g = h[:own] * np.uint32(0x9E3779B1)
                    g ^= g >> np.uint32(15)
                    g *= np.uint32(0x85EBCA77 + 2 * n)
                    yield g >> np.uint32(32 - self.bits)

    def present(self, text: str | None, seen: np.ndarray) -> np.ndarray:
        """Distinct feature numbers; ``seen`` is an all-false scratch array and
        is all-false again afterwards."""
        kept = []
        for g in self.blocks(text):
            g = g[~seen[g]]
            g = np.unique(g)
            seen[g] = True
            kept.append(g)
        found = np.concatenate(kept) if kept else np.zeros(0, np.uint32)
        seen[found] = False
        return found


def levels(space: NgramSpace, used: np.ndarray, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The ``used`` features of a text, and floor(log2(1 + count)) of each."""
    hits = [g[used[g]] for g in space.blocks(text)]
    found, counts = np.unique(np.concatenate(hits), return_counts=True) if hits else (np.zeros(0, np.uint32),) * 2
    return found, np.frexp(counts + 1.0)[1] - 1


@dataclass(frozen=True)
class ToxicityModel:
    space: NgramSpace
    features: np.ndarray  # feature numbers with a weight
    weights: np.ndarray  # coefficient times log-count ratio
    intercept: float

    def score_column(self, text_col):
        """Scalar Arrow function: text -> probability of label 1 (null: as empty)."""
        space, intercept = self.space, self.intercept
        features, weights = self.features, self.weights
        dense: list[np.ndarray] = []

        def arrays():
            if not dense:
                table = np.zeros(space.size, np.float64)
                table[features] = weights
                dense.extend((table, table != 0))
            return dense

        def one(text: str | None) -> float:
            table, used = arrays()
            found, values = levels(space, used, text)
            z = intercept + float((table[found] * values).sum())
            return float(1.0 / (1.0 + np.exp(-min(max(z, -500.0), 500.0))))

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series([one(t) for t in texts], dtype="float64")

        return score(text_col)


def training_sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """Up to ``max_rows`` labelled rows ``(doc_id, label, weight)``: per class
    at most half, the smallest hashes of ``doc_id`` first. ``weight`` stands for
    the rows left out and moves the classes halfway (square root) to balance. Null ids or labels are left out;
    repeated ids count once, with their largest label."""
    per_id = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
              .agg((F.max("toxic") > 0).cast("int").alias("label")))
    totals = {r["label"]: r["n"] for r in per_id.groupBy("label").agg(F.count("*").alias("n")).collect()}
    half = max(1, max_rows // 2)
    parts = []
    for label, total in sorted(totals.items()):
        weight = (total / min(total, half)) * (sum(totals.values()) / total) ** 0.5
        parts.append(per_id.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
                     .withColumn("weight", F.lit(float(weight))))
    if not parts:
        return per_id.withColumn("weight", F.lit(1.0))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def fit(docs: DataFrame, labels: DataFrame, space: NgramSpace = NgramSpace(), max_rows: int = 20_000,
        max_features: int = 8_192, smoothing: float = 1.0, reg: float = 0.002, max_iter: int = 60) -> ToxicityModel:
    """Train on the texts of ``labels`` found in ``docs``.

    1. Per class, count in how many documents each hashed n-gram occurs
       (partial counts per task, summed by a shuffle).
    2. r = log of the ratio of the smoothed class shares; the ``max_features``
       n-grams with the largest |z| of the difference stay.
    3. Logistic regression on floor(log2(1 + count)) x r (Spark ML), ridge ``reg``.

    Without rows of both classes the model gives every text the share of
    label 1 among the labelled rows (0.0 without labels).
    """
    sample = training_sample(labels, max_rows)
    sample = staged(sample, "toxic-sample")  # at most max_rows narrow rows
    classes = {r["label"]: (r["n"], r["w"]) for r in
               sample.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    none = np.zeros(0, np.int64)
    if len(classes) < 2:
        share = 1.0 if classes.get(1) else 0.0
        return ToxicityModel(space, none, np.zeros(0), 40.0 if share else -40.0)
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "toxic-train")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(space.size, bool)
        totals = np.zeros((2, space.size), np.int32)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                totals[label, space.present(text.as_py(), seen)] += 1
        used = np.flatnonzero(totals.any(axis=0))
        for at in range(0, len(used), 50_000):
            f = used[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(totals[0, f].astype(np.int64)),
                                              pa.array(totals[1, f].astype(np.int64))], ["feature", "n0", "n1"])

    counts = rows.select("text", "label").mapInArrow(count, "feature long, n0 long, n1 long")
    counts = counts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3")
    m0, m1 = classes[0][0], classes[1][0]
    p0 = (F.col("n0") + smoothing) / (m0 + 2 * smoothing)
    p1 = (F.col("n1") + smoothing) / (m1 + 2 * smoothing)
    pooled = (F.col("n0") + F.col("n1") + 2 * smoothing) / (m0 + m1 + 4 * smoothing)
    z = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / m0 + 1 / m1) + 1e-12)
    best = (counts.select("feature", F.log(p1 / p0).alias("r"), F.abs(z).alias("z")).where("z > 2.5")
            .orderBy(F.desc("z"), "feature").limit(max_features).collect())  # at most max_features rows
    if not best:
        share = classes[1][1] / (classes[0][1] + classes[1][1])
        return ToxicityModel(space, none, np.zeros(0), float(np.log(share / (1 - share))))
    features = np.array([b["feature"] for b in best], dtype=np.int64)
    ratios = np.array([b["r"] for b in best])

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.zeros(space.size, bool)
        used[features] = True
        for batch in batches:
            found = []
            for text in batch.column("text"):
                grams, values = levels(space, used, text.as_py())
                found.append([str(f) for f in np.repeat(grams, values)])
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.float64()), batch.column("weight"),
                                              pa.array(found, pa.list_(pa.string()))], ["label", "weight", "grams"])

    train = rows.select("text", "label", "weight").mapInArrow(select, "label double, weight double, grams array<string>")
    vectors = CountVectorizerModel.from_vocabulary([str(f) for f in features], "grams", "present")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(ratios), inputCol="present", outputCol="features")
    train = scale.transform(vectors.transform(train)).select("label", "weight", "features")
    train = train.cache()  # bounded; narrow; recomputable from the staged rows
    fitted = LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                                weightCol="weight").fit(train)
    train.unpersist()
    return ToxicityModel(space, features, fitted.coefficients.toArray() * ratios, float(fitted.intercept))


def held_out(doc_id):
    """True for the fifth of the ids whose labels are never learnt (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``; only labels of rows that
    are not held out are used. Columns of those names are replaced, all others
    pass; null and empty texts get a score as well, repeated rows stay."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), **params)
    scored = docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": model.score_column(F.coalesce(F.col("text"), F.lit("")))})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, all columns."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), **params)
    return docs.where(model.score_column(F.coalesce(F.col("text"), F.lit(""))) < 0.5)
