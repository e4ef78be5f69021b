"""Conversation repair against an enumeration of all edits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ampere.llm import ORACLES, QUERIES, repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if harm == 0:
            continue
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if harm == 3 else 1)
    return out


def faults(rows):
    """Kinds of a conversation's (role, text) rows."""
    seen, out = set(), []
    for row in rows:
        core = BLANK.findall(row[1])
        out.append("blank" if not core else "duplicate" if row in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add(row)
    return out


def enumerated(rows, kinds):
    """Cheapest edits by trying all: up to two inserts in every gap, every edit of every row."""
    best = None
    gaps = [[], ["user"], ["assistant"], *map(list, itertools.product(["user", "assistant"], repeat=2))]
    edits = [["D"] if k in ("blank", "duplicate") else ["D", "K", "user", "assistant"] for k in kinds]
    for choice in itertools.product(*edits):
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for k, new in enumerate(fill):
                cost += 2 * len(new)
                audit += "I" * len(new)
                lines += [(r, "") for r in new]
                if k < len(rows):
                    what = choice[k]
                    audit += what if what in "DK" else "R"
                    cost += {"D": 3, "K": 0}.get(what, 2) + (kinds[k] == "truncated" and what != "D")
                    if what != "D":
                        lines.append((rows[k][0] if what == "K" else what, rows[k][1]))
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return best


def stepped(rows, kinds, block_rows=512):
    r = repair.Repair(block_rows)
    for (role, text), kind in zip(rows, kinds):
        r.row(role, text, kind)
    return r.end()


def test_all_short_conversations():
    random.seed(5)
    roles = ["system", "user", "assistant", "tool", " ", ""]
    texts = ["Fine.", "cut off", "", " \t", "Really?", "other!"]
    for _ in range(60):
        rows = [(random.choice(roles), random.choice(texts)) for _ in range(random.randint(0, 3))]
        kinds = faults(rows)
        assert stepped(rows, kinds) == enumerated(rows, kinds), rows


def test_blocks_change_nothing():
    random.seed(6)
    for n in (1, 2, 3, 7, 40, 300):
        for _ in range(12):
            rows = [(random.choice(["user", "assistant", "system", "tool"]), f"{random.randint(0, n)}" + random.choice(["", ".", "!"])) for _ in range(n)]
            kinds = faults(rows)
            assert stepped(rows, kinds, 1) == stepped(rows, kinds, 3) == stepped(rows, kinds), rows


def _want(rows):
    """Result rows without cost, audit and digest, and the damaged rows of each conversation."""
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    bad = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in bad if r[0] == conv), key=order)
        turns = {r[1] for r in own} - {None}
        kinds = faults([r[2:] for r in own])
        illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield conv, (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal), [r[2:] for r in own], kinds


def _check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("kept") for c in ("gone", "cost", "audit", "_kind", "_place")})
    got = {r.conv_id: r for r in repair.repair_conversations(df).collect()}
    want = list(_want(rows))
    assert len(got) == len(want)
    for conv, counts, own, kinds in want:
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == counts
        assert (r.cost, r.audit, r.repaired_sha256) == (enumerated(own, kinds) if len(own) < 4 else stepped(own, kinds))


def test_random_conversations(spark):
    random.seed(7)
    rows = [(c, random.choice([None, *range(6)]), random.choice(["user", "assistant", "system", None, "tool", ""]),
             random.choice([None, "", "Yes.", "no", "Why? ", "\n", "é\u00a0", "x" * 9000 + "."])) for c in range(80) for _ in range(random.randint(1, 4))]
    _check(spark, rows + [(None, 1, "user", "No id."), (None, None, None, None), (5, 2**63 - 1, "user", "Far."), (5, -(2**63), "user", "Far.")][:2])


def test_long_conversation_and_far_turns(spark):
    _check(spark, [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)] + [(2, 2**63 - 1, "user", "Hi.")])
    far = spark.createDataFrame([(3, 2**63 - 1, "user", "Far."), (3, -(2**63) + 1, "assistant", "Far.")], SCHEMA)
    assert [r.gaps for r in repair.repair_conversations(far).collect()] == [2**63 - 1]


def test_all_rows_dropped_and_empty_table(spark):
    gone = [(c, t) for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:4]
    df = spark.createDataFrame([(c, t, "user", "Hello.") for c, t in gone], SCHEMA)
    for r in repair.repair_conversations(df).collect():
        assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_conversations(df.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql_twin(spark, sf):
    from oracle_compare import compare

    r = compare(spark, "op13", QUERIES["op13_weight_repair"], ORACLES["op13_weight_repair"], f"/root/testdata/{sf}")
    assert r["status"] == "match" and r["rows"], r
