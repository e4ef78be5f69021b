"""Licence scan: statements of a file (lines and sentences) are compared with
notices, and passages across line breaks with headers and licence texts, by
sparse TF-IDF cosine; SPDX tags are read as they stand; files without one of their own inherit from the nearest
ancestor directory that holds a licence file. DataFrame functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampere.llm.tables import staged

# Usual notices, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License, the Simplified BSD License"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License, the New or Revised BSD License",
                     "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "EPL-2.0": ["Made available under the terms of the Eclipse Public License 2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "ISC": ["Licensed under the ISC License",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["Released under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
_GPL = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as "
        "published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
          "this software without specific prior written permission. ")
_COPIES = ("Copyright (C) {1} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license "
           "document, but changing it is not allowed. ")
#: Usual headers and the beginnings of licence files, by SPDX identifier.
TEXTS = {
    "AGPL-3.0": [_GPL.format("Affero ", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 " + _COPIES.format("", 2007)
                 + "Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
                   "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License.",
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
                   "DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined "
                   "by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright "
                   "owner that is granting the License."],
    "BSD-2-Clause": [_BSD + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
                     "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "BSD-3-Clause": [_BSD + _BSD_3 + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""],
    "GPL-2.0": [_GPL.format("", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 " + _COPIES.format("", "1989, 1991")
                + "Preamble The licenses for most software are designed to take away your freedom to share and change it."],
    "GPL-3.0": [_GPL.format("", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _COPIES.format("", 2007)
                + "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
            "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "LGPL-3.0": [_GPL.format("Lesser ", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _COPIES.format("", 2007)
                 + "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General "
                 "Public License, supplemented by the additional permissions listed below."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
            "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
                "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, "
                "contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions "
                "of others (if any) used by a Contributor and that particular Contributor's Contribution."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                  "non-commercial, and by any means."],
}
_WIDTHS = (24, 36, 48, 64, 84, 112)  # words of a passage; a text above counts up to the largest that it fills
_ANCHOR = r"^(licen[cs].*|redistribut.*|permission|domain|terms)$"  # a passage is compared around such words
_KNOWN = 0.5  # share of a passage's words that some text above must hold; a cosine of 0.7 needs about that
_SPDX = r"(?i)SPDX-License-Identifier:[ \t(]*([A-Za-z0-9][A-Za-z0-9.+-]*)"
#: a statement that may speak of a licence holds one of these
_GATE = r"(?i)licen[cs]|public domain|cc0|redistribut|permission|subject to the terms|under the terms"
_WIDE_GATE = _GATE.replace(" ", r"\W+")  # a text that may, also over line breaks
_WIDTH, _STEP = 48, 24  # words of a window of a long statement
_TOKEN = "[a-z0-9]+"


def text_templates() -> dict[str, list[str]]:
    """``TEXTS``, each cut to the largest of ``_WIDTHS`` that it fills."""
    words = lambda text: re.findall(_TOKEN, text.lower())
    fill = lambda ws: ws[: max(w for w in _WIDTHS if w <= len(ws))]
    return {name: [" ".join(fill(words(t))) for t in texts] for name, texts in TEXTS.items()}


def template_weights(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES) -> tuple[DataFrame, float]:
    """``(license, template, token, idf, weight)``, weights of unit length per
    template, and the idf of a token that no template has. A fixed table of
    a few hundred rows."""
    rows = [(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    tokens = (spark.createDataFrame(rows, "license string, template int, text string")
              .select("license", "template", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0))).alias("token"))
              .groupBy("license", "template", "token").agg(F.count("*").alias("tf")))
    n = len(rows)
    idf = tokens.groupBy("token").agg((F.log((F.lit(1.0) + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    tokens = tokens.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("license", "template")))
    weights = tokens.select("license", "template", "token", "idf", (F.col("w") / norm).alias("weight"))
    return weights, math.log(1.0 + n) + 1.0


def statements(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, statement, words``: windows of words of the lines and sentences
    that may speak of a licence, from whole texts; ``words``: their number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, r"\n|(?<=[.!?;])\s+"), lambda x: x.rlike(_GATE))
    rows = files.where(text.rlike(_GATE)).select(*keys, F.explode(lines).alias("line"))
    rows = rows.withColumn("tokens", F.regexp_extract_all(F.lower("line"), F.lit(_TOKEN), F.lit(0))).where(F.size("tokens") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("tokens") - (_WIDTH - _STEP), F.lit(1)), F.lit(_STEP))
    rows = rows.withColumn("at", F.explode(starts))
    window = F.slice("tokens", F.col("at"), F.lit(_WIDTH))
    return rows.select(*keys, F.array_join(window, " ").alias("statement"), F.size(window).alias("words"))


def passages(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, statement, words``: windows of words across line breaks, of each
    of ``_WIDTHS`` in steps of a quarter, around the words that ``_ANCHOR``
    matches, if ``_KNOWN`` of their words are words of ``TEXTS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    vocabulary = sorted({w for texts in text_templates().values() for t in texts for w in t.split()})
    rows = files.where(text.rlike(_WIDE_GATE)).select(*keys, F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)).alias("tokens"))
    places = F.filter(F.transform("tokens", lambda t, i: F.when(t.rlike(_ANCHOR), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("places", places).where(F.size("places") > 0)
    steps = lambda w: F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(
        F.greatest(F.ceil((p - w + 1) / (w // 4)), F.lit(0)).cast("int"), F.floor(p / (w // 4)).cast("int")))))
    cut = lambda w: F.transform(steps(w), lambda k: F.slice("tokens", k * (w // 4) + 1, F.lit(w)))
    windows = F.flatten(F.array(*map(cut, _WIDTHS)))
    rows = rows.select(*keys, F.explode(windows).alias("window"))
    share = F.size(F.filter("window", lambda t: F.array_contains(F.lit(vocabulary), t))) / F.size("window")
    return rows.where(share >= _KNOWN).select(*keys, F.array_join("window", " ").alias("statement"), F.size("window").alias("words"))


def tags(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, license, similarity, licensed``: SPDX tags, less ``-only``,
    ``-or-later`` and ``+``; known names as in ``TEMPLATES``."""
    found = files.where(F.col("text").rlike(_SPDX)).select(*keys, F.explode(F.regexp_extract_all("text", F.lit(_SPDX), F.lit(1))).alias("tag"))
    tag = F.regexp_replace("tag", r"(?i)(-only|-or-later|\+)$", "")
    names = F.create_map(*[F.lit(x) for name in TEMPLATES for x in (name.lower(), name)])
    return found.select(*keys, F.coalesce(F.element_at(names, F.lower(tag)), tag).alias("license"), F.lit(1.0).alias("similarity"),
                        F.lit(4).cast("bigint").alias("licensed"))


def similarities(distinct: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``(statement, license, similarity)``: the best template of each
    distinct statement (ties: the first name), if any shares a token."""
    weights, unseen = template_weights(distinct.sparkSession, templates)
    tokens = (distinct.select("statement", F.explode(F.split("statement", " ")).alias("token"))
              .groupBy("statement", "token").agg(F.count("*").alias("tf")))
    idf = F.broadcast(weights.select("token", "idf").distinct())  # tokens of the fixed templates
    tokens = tokens.join(idf, "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen))).drop("idf")
    norms = tokens.groupBy("statement").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (tokens.join(F.broadcast(weights.select("license", "template", "token", "weight")), "token")
            .groupBy("statement", "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot")))
    scored = dots.join(norms, "statement").select("statement", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity"))
    best = scored.groupBy("statement").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("b"))
    return best.select("statement", F.col("b.license").alias("license"), (-F.col("b.less")).alias("similarity"))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def scan(files: DataFrame, least: float = 0.7, file_share: float = 0.2, named: str = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$") -> DataFrame:
    """``doc_id, path, license, similarity, origin, from_directory`` of every
    row of ``files (doc_id, path, text)``.

    A file's own licence (``origin`` ``header``) is that of its SPDX tag or its
    most similar statement or passage, from ``least`` on (ties: the first name). It is a licence file
    if its name says so or licence statements make up ``file_share`` of its
    words. A directory has the licence of most of its licence files (ties: the
    first name); a file without its own takes the nearest ancestor
    directory's (``inherited``). Otherwise ``license`` and the rest are null.
    Null texts have no licence of their own; null paths inherit nothing; rows
    that share id and path share a licence and all stay; other columns are
    ignored; an empty table gives an empty result.
    """
    files = files.select("doc_id", "path", "text")
    keys = ["doc_id", "path"]
    found = staged(statements(files, keys), "license-statements")
    best = similarities(found.select("statement").distinct()).where(F.col("similarity") >= least)
    own = found.join(best, "statement").groupBy(*keys).agg(
        F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("b"), F.sum("words").alias("licensed"))
    own = own.select(*keys, F.col("b.license").alias("license"), (-F.col("b.less")).alias("similarity"), "licensed")
    wide = staged(passages(files, keys), "license-passages")
    best = similarities(wide.select("statement").distinct(), text_templates()).where(F.col("similarity") >= least)
    texts = wide.join(best, "statement").select(*keys, "license", "similarity", F.col("words").cast("bigint").alias("licensed"))
    own = own.unionByName(texts).unionByName(tags(files, keys)).groupBy(*keys).agg(  # passages overlap: the longest counts
        F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("b"), F.max("licensed").alias("licensed"))
    own = staged(own.select(*keys, F.col("b.license").alias("license"), (-F.col("b.less")).alias("similarity"), "licensed"), "license-own")
    words = F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\S+"), F.lit(0)))
    # only files that have a statement need their words counted
    counted = files.where(F.coalesce("text", F.lit("")).rlike(_WIDE_GATE)).select(*keys, words.alias("words")).distinct()
    carriers = own.join(counted, (own["doc_id"].eqNullSafe(counted["doc_id"])) & (own["path"] == counted["path"])).select(
        own["path"], own["license"], "licensed", "words")
    carriers = carriers.where(F.col("path").rlike(named) | (F.col("licensed") >= file_share * F.col("words")))
    votes = carriers.groupBy(directory_of(F.col("path")).alias("directory"), "license").agg(F.count("*").alias("n"))
    of_directory = votes.groupBy("directory").agg(F.min(F.struct((-F.col("n")).alias("less"), "license")).alias("b"))
    of_directory = of_directory.select(F.col("directory").alias("from_directory"), F.col("b.license").alias("inherited"))
    directories = files.where("path is not null").select(directory_of(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")  # a/b/ -> [a, b, ""]: its ancestors are a/b/, a/ and the root ""
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(
        k.alias("depth"), F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.when(k > 0, F.lit("/")).otherwise(F.lit(""))).alias("from_directory")))
    above = directories.select("directory", F.explode(up).alias("a")).select("directory", "a.depth", "a.from_directory")
    nearest = above.join(of_directory, "from_directory").groupBy("directory").agg(
        F.max_by(F.struct("inherited", "from_directory"), "depth").alias("b")).select("directory", "b.*")
    mine = own.withColumnsRenamed({"doc_id": "_id", "path": "_path"})
    rows = files.select(*keys, directory_of(F.col("path")).alias("_directory"))
    rows = rows.join(mine, F.col("_id").eqNullSafe(rows["doc_id"]) & F.col("_path").eqNullSafe(rows["path"]), "left")
    rows = rows.join(nearest, F.col("_directory") == F.col("directory"), "left")
    header = F.col("license").isNotNull()
    return rows.select(
        *[rows[k] for k in keys], F.coalesce("license", "inherited").alias("license"), "similarity",
        F.when(header, F.lit("header")).when(F.col("inherited").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(~header, F.col("from_directory")).alias("from_directory"))


def oracle_sql(files: str, least: float = 0.7, file_share: float = 0.2) -> str:
    """DuckDB twin of ``scan`` over the subquery ``files (doc_id, path, text)``
    with at most four directories above a file; file names, SPDX tags and
    passages across lines (which the test documents do not hold) play no part."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, {i}, {quote(text)})" for name, texts in TEMPLATES.items() for i, text in enumerate(texts))
    n = sum(map(len, TEMPLATES.values()))
    return f"""
WITH files AS ({files}),
template_tf AS (
  SELECT license, template, token, COUNT(*) AS tf FROM (
    SELECT license, template, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS token FROM (VALUES {rows}) v(license, template, text)) t
  GROUP BY ALL),
idf AS (SELECT token, ln((1.0 + {n}) / (1.0 + COUNT(*))) + 1.0 AS idf FROM template_tf GROUP BY token),
weights AS (
  SELECT license, template, token, tf * idf / sqrt(SUM(tf * idf * tf * idf) OVER (PARTITION BY license, template)) AS weight
  FROM template_tf JOIN idf USING (token)),
-- an end of a sentence ends a line as well
lines AS (
  SELECT doc_id, path, unnest(string_split(regexp_replace(COALESCE(text, ''), '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS line FROM files),
tokens AS (
  SELECT doc_id, path, regexp_extract_all(lower(line), '{_TOKEN}') AS tokens FROM lines WHERE regexp_matches(line, '{_GATE}')),
windows AS (
  SELECT doc_id, path, list_slice(tokens, s, s + {_WIDTH - 1}) AS w FROM (
    SELECT doc_id, path, tokens, unnest(range(1, greatest(len(tokens) - {_WIDTH - _STEP}, 1) + 1, {_STEP})) AS s
    FROM tokens WHERE len(tokens) > 0) x),
statements AS (SELECT doc_id, path, array_to_string(w, ' ') AS statement, len(w) AS words FROM windows),
statement_tf AS (
  SELECT statement, token, COUNT(*) AS tf FROM (
    SELECT statement, unnest(string_split(statement, ' ')) AS token FROM (SELECT DISTINCT statement FROM statements) d) t GROUP BY ALL),
vectors AS (SELECT statement, token, tf * COALESCE(idf, ln(1.0 + {n}) + 1.0) AS w FROM statement_tf LEFT JOIN idf USING (token)),
norms AS (SELECT statement, sqrt(SUM(w * w)) AS norm FROM vectors GROUP BY statement),
scored AS (
  SELECT statement, license, ROUND(dot / norm, 6) AS similarity FROM (
    SELECT statement, license, template, SUM(w * weight) AS dot FROM vectors JOIN weights USING (token) GROUP BY ALL) d JOIN norms USING (statement)),
best AS (SELECT statement, arg_min(license, (-similarity, license)) AS license, MAX(similarity) AS similarity FROM scored GROUP BY statement),
own AS (
  SELECT doc_id, path, arg_min(license, (-similarity, license)) AS license, MAX(similarity) AS similarity, SUM(words) AS licensed
  FROM statements JOIN best USING (statement) WHERE similarity >= {least} GROUP BY doc_id, path),
carriers AS (
  SELECT DISTINCT o.doc_id, o.path, o.license FROM own o JOIN files f ON f.doc_id = o.doc_id AND f.path = o.path
  WHERE licensed >= {file_share} * len(regexp_extract_all(lower(f.text), '\\S+'))),
votes AS (SELECT regexp_replace(path, '[^/]*$', '') AS directory, license, COUNT(*) AS n FROM carriers GROUP BY ALL),
of_directory AS (SELECT directory AS from_directory, arg_min(license, (-n, license)) AS inherited FROM votes GROUP BY directory),
directories AS (SELECT DISTINCT regexp_replace(path, '[^/]*$', '') AS directory FROM files),
up AS (
  SELECT directory, directory AS a, 4 AS depth FROM directories
  UNION ALL SELECT directory, regexp_replace(directory, '[^/]*/$', ''), 3 FROM directories
  UNION ALL SELECT directory, regexp_replace(directory, '[^/]*/[^/]*/$', ''), 2 FROM directories
  UNION ALL SELECT directory, '', 1 FROM directories),
nearest AS (
  SELECT directory, arg_max(inherited, depth) AS inherited, arg_max(from_directory, depth) AS from_directory
  FROM up JOIN of_directory ON from_directory = a GROUP BY directory)
SELECT f.doc_id, f.path, COALESCE(o.license, inherited) AS license, similarity,
  CASE WHEN o.license IS NOT NULL THEN 'header' WHEN inherited IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN o.license IS NULL THEN from_directory END AS from_directory
FROM files f LEFT JOIN own o ON o.doc_id = f.doc_id AND o.path = f.path
LEFT JOIN nearest ON directory = regexp_replace(f.path, '[^/]*$', '')"""
