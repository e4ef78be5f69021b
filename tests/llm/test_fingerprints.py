"""Lempel-Ziv fingerprints against plain definitions."""

import hashlib

import pytest

from ampere.llm import fingerprints as fp

from llm_tables import documents


def phrases(text):
    """The dictionary phrases of a text, the unfinished last one included."""
    found, start = [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in found:
            found.append(text[start:end])
            start = end
    return set(found) | ({text[start:]} - {""})


def check(rows, ordered):
    following = [*ordered[1:], *ordered[:1]]
    got = sorted(((r.doc_id is not None, r.doc_id, r.edited_sha256, r) for r in rows), key=lambda x: x[:3])
    wanted = []
    for (i, t), (_, u) in zip(ordered, following):
        t, u = t or "", u or ""
        n = len(t)
        edited = t[: n - n // 2] + u[: n // 2]
        wanted.append((i is not None, i, hashlib.sha256(edited.encode()).hexdigest(), n, t, edited, u))
    wanted.sort(key=lambda x: x[:3])
    assert len(got) == len(wanted)
    for (_, i, digest, r), (_, j, want, n, t, edited, u) in zip(got, wanted):
        assert (i, digest, r.n_chars) == (j, want, n)
        assert r.fingerprint == fp.fingerprint(t) and r.edited_fingerprint == fp.fingerprint(edited)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if t == edited:
            assert r.near_edited == 1


@pytest.mark.parametrize("partition_rows", [7, 5000])
def test_documents(small, texts, partition_rows):
    check(fp.fingerprint_edits(small, partition_rows).collect(), sorted(texts.items()))


def test_odd_rows(spark, odd, empty):
    check(fp.fingerprint_edits(documents(spark, [(4, "only one")])).collect(), [(4, "only one")])
    rows = [(1, None), (2, ""), (3, "aaaa"), (4, "b" * 3000), (5, "\U0001F600xyz" * 9), (9, "end")]
    for partition_rows in (1, 2, 100):
        check(fp.fingerprint_edits(documents(spark, rows), partition_rows).collect(), rows)
    assert fp.fingerprint_edits(odd, 4).count() == odd.count()
    assert fp.fingerprint_edits(empty).count() == 0


def test_phrase_hashes_are_those_of_the_phrases():
    for text in ("", "a", "abababab", "the cat sat on the cat " * 30, "é😀" * 40):
        found = {}
        rest = fp.parse(text, found)
        assert set(found) | ({rest} - {""}) == phrases(text)
        one_by_one = {int(fp.phrase_hashes({p: None}, "")[0]) for p in [*found, *([rest] if rest else [])]}
        assert set(map(int, fp.phrase_hashes(found, rest))) == one_by_one


def test_likeness_estimates_the_jaccard():
    a = " ".join(f"word{k % 97}" for k in range(900))
    b = a[:2500] + " ".join(f"other{k % 53}" for k in range(500))
    x, y = phrases(a), phrases(b)
    true = len(x & y) / len(x | y)
    sig = [fp.signature(f, fp.parse(t, f)) for t, f in ((a, {}), (b, {}))]
    assert abs(fp.likeness(*sig) - true) < 0.2
    assert fp.likeness(sig[0], sig[0]) == 1
