"""Licence scan: cosine against plain arithmetic, and inheritance."""

import collections
import math
import re

from ampere.llm import licenses


def files(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, path string, text string")


def cosine_to(statement):
    """Best (similarity, license) of a statement, by definition."""
    docs = [(name, re.findall("[a-z0-9]+", t.lower())) for name, ts in licenses.TEMPLATES.items() for t in ts]
    df = collections.Counter(w for _, ws in docs for w in set(ws))
    idf = lambda w: math.log((1 + len(docs)) / (1 + df[w])) + 1 if w in df else math.log(1 + len(docs)) + 1
    vector = lambda ws: {w: n * idf(w) for w, n in collections.Counter(ws).items()}
    a = vector(re.findall("[a-z0-9]+", statement.lower()))
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = []
    for name, ws in docs:
        b = vector(ws)
        best.append((-round(sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b)), 6), name))
    return min(best)


def test_similarity_equals_definition(spark):
    lines = ["licensed under the mit license", "released under mit license now", "this program is licensed under gnu general public license version 2 or later",
             "a license of some kind", "use of this source code is governed by a bsd license found in the license file"]
    got = {r.statement: (-r.similarity, r.license) for r in licenses.similarities(spark.createDataFrame([(x,) for x in lines], "statement string")).collect()}
    for line in lines:
        want = cosine_to(line)
        assert got[line][1] == want[1] and abs(got[line][0] - want[0]) < 2e-6


def test_headers_and_inheritance(spark):
    code = "some words of a file that says nothing " * 20
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\n" + code), (2, "a/x.txt", code), (3, "a/b/c/y.txt", None),
        (4, "a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0."), (5, "a/b/z.txt", f"# Licensed under CC BY-NC 4.0.\n{code}"),
        (6, "other/x.txt", code), (7, "a/b/c/d/e.txt", "x"), (8, "ab/x.txt", code), (9, None, code),
        (10, "v/1.txt", "Licensed under the Apache License, Version 2.0."), (11, "v/2.txt", "Released under the MIT License."),
        (12, "v/3.txt", "Released under the MIT License."), (13, "v/4.txt", code), (14, "v/w/5.txt", f"We like licences. {code}"),
    ]
    got = {r.doc_id: (r.license, r.origin, r.from_directory) for r in licenses.scan(files(spark, rows)).collect()}
    assert got == {
        1: ("MIT", "header", None), 2: ("MIT", "inherited", "a/"), 3: ("Apache-2.0", "inherited", "a/b/"),
        4: ("Apache-2.0", "header", None), 5: ("CC-BY-NC-4.0", "header", None), 6: (None, None, None),
        7: ("Apache-2.0", "inherited", "a/b/"), 8: (None, None, None), 9: (None, None, None),
        10: ("Apache-2.0", "header", None), 11: ("MIT", "header", None), 12: ("MIT", "header", None),
        13: ("MIT", "inherited", "v/"), 14: ("MIT", "inherited", "v/"),
    }


def test_root_licence_and_long_lines(spark):
    long = "word " * 30_000 + "released under the MIT License " + "word " * 30_000
    rows = [(1, "COPYING", "Released under the MIT License."), (2, "x/y/z.txt", "hello"), (3, "t.txt", long)]
    got = {r.doc_id: (r.license, r.origin, r.from_directory) for r in licenses.scan(files(spark, rows)).collect()}
    assert got[2] == ("MIT", "inherited", "") and got[3][0] == "MIT"


def test_odd_rows(spark, odd, empty):
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count() and {r.license for r in rows} == {None}
    assert licenses.scan(empty.withColumn("path", empty["lang"])).count() == 0
    twice = files(spark, [(1, "a/x", "Released under the MIT License.")] * 2 + [(None, "a/x", "Licensed under CC BY-NC 4.0."), (2, None, "Licensed under CC BY-NC 4.0.")])
    got = sorted(str((r.doc_id, r.license, r.origin)) for r in licenses.scan(twice).collect())
    assert got == ["(1, 'MIT', 'header')", "(1, 'MIT', 'header')", "(2, 'CC-BY-NC-4.0', 'header')", "(None, 'CC-BY-NC-4.0', 'header')"]


def test_documents_against_their_lines(spark, small, texts):
    from ampere.llm import QUERIES

    marks = {"GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0"}
    for r in QUERIES["op5_license_paths"](spark, "/root/testdata/sf0.001").collect():
        own = {v for k, v in marks.items() if k in texts[r.doc_id]}
        assert (r.origin == "header") == bool(own) and (not own or r.license in own)


def test_sql_twin(spark):
    from oracle_compare import compare

    from ampere.llm import ORACLES, QUERIES

    r = compare(spark, "op5", QUERIES["op5_license_paths"], ORACLES["op5_license_paths"], "/root/testdata/sf0.01")
    assert r["status"] == "match", r


def test_headers_over_lines_licence_files_and_tags(spark):
    import textwrap

    code = "\n".join("x = compute(alpha, beta, row_%d) + other_value" % i for i in range(80))
    wrap = lambda text, mark: textwrap.fill(text, 70, initial_indent=mark, subsequent_indent=mark)
    t = licenses.TEXTS
    rows, want = [], {}

    def add(path, text, name):
        rows.append((len(rows), path, text))
        want[len(rows) - 1] = name

    for k, (name, mark) in enumerate((("GPL-3.0", "# "), ("GPL-2.0", " * "), ("LGPL-3.0", "// "), ("AGPL-3.0", "# "), ("Apache-2.0", "# "), ("MPL-2.0", "-- "))):
        for before in (0, 7, 31):  # words in front move the windows
            add(f"h{k}/{before}.py", "word " * before + "\n# Copyright (C) 2020 Some One\n" + wrap(t[name][0], mark) + "\n" + code, name)
    for k, name in enumerate(("BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "Unlicense", "Apache-2.0", "GPL-3.0", "GPL-2.0", "MPL-2.0")):
        add(f"f{k}/LICENSE", "Copyright (c) 2020, Some One. All rights reserved.\n\n" + wrap(t[name][-1], "    "), name)
        add(f"f{k}/src/a.py", code, name)
    for k, (tag, name) in enumerate((("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-or-later", "GPL-3.0"), ("gpl-2.0+", "GPL-2.0"), ("Zlib", "Zlib"))):
        add(f"s{k}/a.c", f"/* SPDX-License-Identifier: {tag} */\n{code}", name)
    add("n/a.py", f"# Released under the MIT License.\n{code}", "MIT")
    add("n2/a.py", f"# We read the terms of the licence once and had permission.\n{code}", None)
    got = {r.doc_id: r.license for r in licenses.scan(files(spark, rows)).collect()}
    assert got == want, {rows[k][1]: (got[k], want[k]) for k in want if got[k] != want[k]}
