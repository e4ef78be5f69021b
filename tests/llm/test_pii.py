"""Personal data: base spans against the plain patterns, extras, redaction."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ampere.llm import pii
from llm_tables import ODD, documents

# the patterns as stated, for Python's re
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    "a@b.com_x@y.com-z@q.org", "1.2.3.4.5.6.7.8 1.2.3 999.1.1.1 1.2.3.4 001.002.0003.255 1.2.3.256",
    "x@y..z@w.co \U0001F600 me@ex.io é4111 1111 1111 1111é", "4111111111111111 4111-1111-1111-1111 41111111111111112222 4111  1111",
    "+1 (017) 555-7713 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7 +4930123456 x+49 30 (1) .5", "a%@b@c.d @x.y .@-.- 1" + "2" * 3000,
    "john.doe (at) mail (dot) example.com call 212-555-0187 today", "card: 4111. 1111. 1111. 1111 ip 10[.]0[.]0[.]1",
    "@@@ a@b c@d.e..f@g.h", "9" * 19 + " " + "a" * 5000 + "@x.yz", "+1 555\n123 4567 +1((((((((2 3)-4.5 6789012", "5500-0000 0000-0004,5500 0000 0000 0005",
    *ODD,
]


@pytest.fixture(scope="module")
def hard(spark, small):
    """The hard texts among a corpus that the trees can learn from."""
    rows = documents(spark, [(10_000 + i, t) for i, t in enumerate(HARD)])
    wide = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(rows.columns)
    return rows.unionAll(wide.withColumn("doc_id", wide.doc_id + 100_000))


def test_base_spans(hard):
    texts = {r.doc_id: r.text for r in hard.select("doc_id", "text").collect()}
    rows = pii.find_personal_data(hard).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k + ":") for s in want) for k in PLAIN]
        assert set(want) <= set(r.spans.split(",")) | {""}
        order = [(list(PLAIN).index(s.split(":")[0]), int(s.split(":")[1])) for s in r.spans.split(",") if s]
        assert order == sorted(order)
    extras = {r.doc_id - 10_000: set(r.spans.split(",")) for r in rows if 10_000 <= r.doc_id < 100_000}
    assert "email:0:36" in extras[6] and any(s.startswith("phone:") for s in extras[6])
    assert "card:6:28" in extras[7] and "ip:32:46" in extras[7]


STAY = ["version 1 . 2 . 3 . 4 is out", "see section 10 . 1 . 2 . 3 below", "rates were 100 200 3000 that year", "serial 123-456-7890-77 on the back",
        "ISBN 978-316-1484 in print", "meet us @ noon.today", "tickets @ 12.50 each", "the order 212 555 0187 was late", "firmware 10[.]0[.]0[.]1 shipped",
        "part no. 4111. 1111. 1111. 1111 of the list", "it grew from 120 130 1400 to more", "they sat @ the.table and ate"]
GO = {"write to jane.roe (at) mail (dot) example.org now": "email", "contact bob [at] site.net": "email", "mail ann @ example.com please": "email",
      "call 212-555-0187 today": "phone", "phone: (212) 555-0187": "phone", "tel 212 555 0187 any time": "phone",
      "the ip address 10[.]0[.]0[.]1 answers": "ip", "server 10 . 0 . 0 . 1 is down": "ip", "card number 4111. 1111. 1111. 1111": "card"}


@pytest.fixture(scope="module")
def model(spark):
    wide = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.fit(pii.candidates(wide))


def test_trees_use_format_and_context(model):
    weights = dict(zip(pii.FEATURES, model.trees.featureImportances.toArray()))
    assert not {"passes", "passes_no", "base"} & set(weights) and max(weights.values()) < 0.6
    formats = sum(weights[f] for f in ("chars", "digits", "letters", "spaces", "hyphens", "dots", "brackets", "ats", "groups", "domain"))
    contexts = sum(weights[f] for f in ("digits_near", "assigned", "goes_on", "spoken", "denied", "letter_before", "digit_before"))
    assert formats > 0.1 and contexts > 0.1, weights
    assert set(model.held_out) == set(pii.KINDS) and all(p >= 0.95 and r >= 0.8 for p, r in model.held_out.values()), model.held_out


def test_loose_spans_are_judged_by_their_context(spark, model):
    rows = documents(spark, list(enumerate([*STAY, *GO])))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.judged_spans(pii.candidates(rows), model).collect()}
    assert {STAY[i]: got[i] for i in range(len(STAY)) if got.get(i)} == {}
    assert {t: k for i, (t, k) in enumerate(GO.items(), len(STAY)) if [s[0] for s in got.get(i, [])] != [k]} == {}


def test_no_kind_fills_the_training_rows(spark):
    rows = [(k, f"mail person{k}@example.com or {k % 3}@copies.org") for k in range(3000)] + [(9000 + k, f"host 10.0.0.{k} up") for k in range(40)]
    p = pii.PiiParams(max_rows=1800)
    counts = {r.kind: r["count"] for r in pii.training_rows(pii.candidates(documents(spark, rows)), p).groupBy("kind").count().collect()}
    assert counts == {"email": 450, "ip": 360}


def test_every_base_span_is_learned_from_or_held_out(spark, monkeypatch):
    """2,500 addresses make 22,500 rows to learn from; the few hosts weigh what they are."""
    rows = [(k, f"mail person{k}@example{k % 7}.com now") for k in range(2500)] + [(9000 + k, f"host 10.0.0.{k} up") for k in range(40)]
    found = pii.candidates(documents(spark, rows))
    tables = []
    monkeypatch.setattr(pii, "staged", lambda df, name: tables.append(df.cache()) or tables[-1])
    pii.fit(found)
    counts = {r.kind: r.n for r in tables[0].groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    tables[0].unpersist()
    assert counts == {"email": 22_500, "ip": 360}


def test_redaction(hard):
    # one tail of the corpus is enough here: the texts of the hard rows
    rows = {r.doc_id - 10_000: r for r in pii.redact(hard).where("doc_id between 10000 and 99999").collect()}
    assert rows[2].text == "x@[EMAIL] \U0001F600 [EMAIL] é[CARD]é" and rows[2].n_chars == len(rows[2].text)
    for i, text in enumerate(HARD):
        if not base_spans(text) and i > 10:
            assert rows[i].text == text


def test_odd_rows(spark, odd, empty):
    rows = pii.find_personal_data(odd).collect()
    assert len(rows) == odd.count() and {r.base_sha256 for r in rows if r.doc_id in (0, 1, 3)} == {hashlib.sha256(b"").hexdigest()}
    same = pii.redact(odd)
    assert same.columns == odd.columns and sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))
    assert pii.find_personal_data(empty).count() == 0
    twice = documents(spark, [(1, "mail a@b.co"), (1, "mail a@b.co"), (None, "c@d.org"), (2, "none")]).select("doc_id", "text")
    got = sorted(str((r.doc_id, r.spans)) for r in pii.find_personal_data(twice).collect())
    assert got == ["(1, 'email:5:11')", "(1, 'email:5:11')", "(2, '')", "(None, 'email:0:7')"]


def test_no_python_runs_on_the_executors(small):
    plan = pii.find_personal_data(small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
