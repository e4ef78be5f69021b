"""Repeated spans: passages over 50 words, shifts, and what is left alone."""

import random

import numpy as np

from ampere.llm import substring_dedup as sub

from llm_tables import documents


def gear(points):
    """The rolling hash, character by character."""
    h, out = 0, []
    for c in points.tolist():
        h = ((h << 1) + int(sub._GEAR[c & 0xFFFF])) & 0xFFFF
        out.append(h)
    return out


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_hash_equals_rolling_and_cuts_cover():
    rng = random.Random(1)
    text = text_of(rng, 500)
    points = sub.codepoints(text)
    assert sub.gear_hashes(points).tolist() == gear(points)
    p = sub.ChunkParams()
    for t in ("", "a", text, "z" * 5000, "日本" * 400):
        ends = sub.cuts(sub.codepoints(t), p)
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(t) and all(s <= p.most for s in sizes) and all(s >= p.least for s in sizes[:-1])


def test_cuts_do_not_depend_on_parts_and_move_with_the_text():
    rng = random.Random(2)
    text = text_of(rng, 400_000)
    ends = sub.cuts(sub.codepoints(text), sub.ChunkParams())
    moved = sub.cuts(sub.codepoints("some inserted words " + text), sub.ChunkParams())
    shift = len("some inserted words ")
    assert len(set(ends) & {e - shift for e in moved}) >= len(ends) - 3


def test_planted_passages(spark):
    rng = random.Random(4)
    passages = [text_of(rng, 60) for _ in range(5)]
    rows, planted = [], {}
    for d in range(120):
        body = [text_of(rng, rng.randrange(20, 200)) for _ in range(2)]
        if d % 3 == 0:
            planted[d] = passages[d // 3 % 5]
            body.insert(1, planted[d])
        rows.append((d, " ".join(body)))
    texts = dict(rows)
    spans = sub.repeated_spans(documents(spark, rows)).collect()
    later = {d for d in planted if d // 3 >= 5}
    assert {r.doc_id for r in spans} == later
    for r in spans:
        at = texts[r.doc_id].index(planted[r.doc_id])
        assert at - 16 <= r.start and r.start + r.length <= at + len(planted[r.doc_id]) + 16
        assert texts[r.doc_id][r.start : r.start + r.length] in texts[r.copy_of[0]]
    cut = {r.doc_id: r.text for r in sub.deduplicate(documents(spark, rows)).collect()}
    for d, t in texts.items():
        own = [(r.start, r.start + r.length) for r in spans if r.doc_id == d]
        assert cut[d] == "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in own))


def test_odd_rows(odd, empty):
    spans = sub.repeated_spans(odd)
    assert spans.columns == ["doc_id", "start", "length", "chunks", "copy_of"] and spans.count() == 0
    assert sub.repeated_spans(empty).count() == 0
    same = sub.deduplicate(odd)
    assert same.columns == odd.columns
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "")
    assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, odd.collect()), key=str)


def test_copies_are_spans_of_the_first(spark):
    text = text_of(random.Random(9), 100)
    spans = sub.repeated_spans(documents(spark, [(5, text), (2, text), (9, text), (9, text)])).collect()
    assert sorted((r.doc_id, r.start, r.length, r.copy_of) for r in spans) == [(5, 0, len(text), [2]), (9, 0, len(text), [2])]


def test_short_copies_and_passages_without_a_long_run(spark):
    rng = random.Random(6)
    p = sub.ChunkParams()

    def longest_run(text, passage):
        at, ends = text.index(passage), sub.cuts(sub.codepoints(text), p)
        inside = [e for e in [0, *ends] if at <= e <= at + len(passage)]
        return inside[-1] - inside[0] if len(inside) > 1 else 0

    rows, planted = [(1, "Thanks, all done."), (2, "Thanks, all done."), (3, "Thanks, all gone.")], {}
    while len(planted) < 12:  # passages whose whole chunks are shorter than a span
        passage = text_of(rng, 51)
        d = len(rows) + 1
        texts = [f"{text_of(rng, 90)} {passage} {text_of(rng, 90)}" for _ in range(2)]
        if 0 < max(longest_run(t, passage) for t in texts) < p.span:
            rows += [(d, texts[0]), (d + 1, texts[1])]
            planted[d + 1] = passage
    # the first holder of a chunk need not be the one that shares the passage
    passage, texts = list(planted.items())[0][1], dict(rows)
    runs = [c for c in zip([0, *sub.cuts(sub.codepoints(passage), p)], sub.cuts(sub.codepoints(passage), p)) if c[1] < len(passage)]
    rows.append((0, f"{text_of(rng, 30)} {passage[max(0, runs[0][0] - 16) : runs[-1][1]]}"))
    texts = dict(rows)
    spans = sub.repeated_spans(documents(spark, rows)).collect()
    got = {r.doc_id: r for r in spans if r.doc_id in planted}
    assert (2, 0, 17, [1]) in [(r.doc_id, r.start, r.length, r.copy_of) for r in spans] and 3 not in {r.doc_id for r in spans}
    assert set(got) == set(planted)
    for d, passage in planted.items():
        at = texts[d].index(passage)
        assert got[d].start <= at and got[d].start + got[d].length >= at + len(passage)
        assert any(texts[d][got[d].start : got[d].start + got[d].length] in texts[c] for c in got[d].copy_of)


def test_no_text_is_lost_where_ids_repeat_or_are_null(spark):
    rng = random.Random(11)
    t, u, v = (text_of(rng, 100) for _ in range(3))
    rows = [(1, t), (5, t), (5, u), (5, u), (None, v), (None, v), (None, f"{text_of(rng, 30)} {t}"), (6, None)]
    cut = sub.deduplicate(documents(spark, rows)).collect()
    texts = sorted((str(r.doc_id), r.text) for r in cut if r.text)
    assert len(cut) == len(rows) and [x for x in texts if x[0] != "None"] == sorted([("1", t), ("5", u), ("5", u)])
    alone = [x for i, x in texts if i == "None"]
    assert v in alone and len(alone) == 2 and all(t not in x for x in alone)


def test_all_spans_against_a_search_of_all_substrings(small, texts):
    """Every character of a span lies in a substring that a document of smaller
    id has too; of the characters in shared substrings of 200 and more (as long
    as a passage of 40 words) nearly all are found."""
    spans = {}
    for r in sub.repeated_spans(small).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    seen = {n: set() for n in (32, 200)}
    found = shared = wrong = listed = 0
    for d in sorted(texts):
        t = texts[d]
        cover = {n: np.zeros(len(t) + 1, int) for n in seen}
        for n, grams in seen.items():
            own = [hash(t[k : k + n]) for k in range(len(t) - n + 1)]
            for k, h in enumerate(own):
                if h in grams:
                    cover[n][k : k + n] = 1
            grams.update(own)
        mine = np.zeros(len(t) + 1, bool)
        for a, b in spans.get(d, []):
            mine[a:b] = True
            if b - a >= 96:
                listed += b - a
                wrong += int((cover[32][a:b] == 0).sum())
        found += int((mine & (cover[200] == 1)).sum())
        shared += int(cover[200].sum())
    assert shared > 10_000 and listed > 10_000 and wrong == 0
    assert found >= 0.97 * shared, (found, shared)
