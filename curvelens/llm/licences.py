"""Operator 5, licence scan: normalised text against licence templates by Dice over word bigrams.

Text is normalised by lower-casing and by taking words [a-z0-9]+. Segments of a document are
its whole text and, if it has several, its lines and its paragraphs. A segment matches a template if
2 * |A & B| / (|A| + |B|) >= DICE, A and B being their sets of word bigrams; for each segment
the best template counts (first name on ties).

`op5_licence_scan` also finds a licence inside a longer text (`passages`): a window is a run of
places of the whole text's bigrams, from one that a template has to another, of at most (2 - d) / d
times the template's length. Its score is Dice, places without a bigram of the template
counting one each and repeats of one not at all. The best window of each template counts, unless
it overlaps one of another template that shares more bigrams (BSD-2-Clause lies in BSD-3-Clause).
A licence that only windows find is one match more; segments' results stay as they are, and
come first. The SQL has segments only.

Plan: SQL functions only. Dice >= d bounds sizes: |A| lies between |B| * d / (2 - d) and
|B| * (2 - d) / d, so a segment with too few or too many words for every template is dropped
before bigrams are made, and templates are pruned for each segment by the same bounds in the
join. Segments' distinct bigrams meet the templates' bigrams (a fixed list, a few thousand
rows) in a broadcast join, which only shared bigrams survive. Before any of this, a text and a
segment must hold a mark: marks are the letters with which words begin that so many bigrams of every
template have that no text without them can share enough bigrams with any (`marks_of` finds them
from the templates). Most texts have none and end there; counting them gives the
intersection. A licence line that a third of all documents share is a row per document in a
group of its own: the grouping key is the segment. Windows need no text: places of shared bigrams
meet by text and template, and most are dropped as two thirds of a template must be there; a window
begins only at places with so many others within its reach.

Defined results. Null, empty and unmatched texts have no licence, 0 matches and score 0. Rows
with one doc_id and one text are one document for counting and each get the result. A null
doc_id is kept. Other columns of the table are not looked at.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.llm.common import NULL_ID, identity, named, table

DICE = 0.8

# Notices and short texts of public licences, by SPDX name (one name may have several).
TEMPLATES = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]


def size_bounds(dice: float) -> tuple[float, float]:
    """Least and largest |A| / |B| at which Dice can reach this; a little wide, for rounding."""
    return dice / (2 - dice) * (1 - 1e-9), (2 - dice) / dice * (1 + 1e-9)


# Words too common to tell a licence by.
COMMON = "a all an and any are as at be by can for from has have if in is it its may more no not of on one or that the this to under use was which with you".split()


def marks_of(templates: list[tuple[str, str]], dice: float, letters: int = 6) -> list[str]:
    """Beginnings of words (whole words of two letters), one of which is in every text that reaches this Dice with some template.

    A text must share `need` of a template's distinct bigrams, so it holds at least one of any set of
    more than size - need of them. Marks are taken, the one that serves most templates first, until in
    each template that many bigrams have one. A template without enough such bigrams gives no marks: every text is looked at.
    """
    open_, chosen = [], []
    for _, text in templates:
        words = re.findall("[a-z0-9]+", text.lower())
        grams = {*zip(words, words[1:], strict=False)}
        open_.append(([{w[:letters] for w in g if len(w) > 1 and not w.isdigit() and w not in COMMON} for g in grams], len(grams) - math.ceil(len(grams) * size_bounds(dice)[0]) + 1))
    while open_:
        serves: dict[str, int] = {}
        for grams, need in open_:
            for mark in set().union(*grams):
                serves[mark] = serves.get(mark, 0) + min(need, sum(mark in g for g in grams)) * len(mark) ** 2
        if not serves:
            return []
        chosen.append(max(sorted(serves), key=serves.get))
        open_ = [([g for g in grams if chosen[-1] not in g], need - sum(chosen[-1] in g for g in grams)) for grams, need in open_]
        open_ = [x for x in open_ if x[1] > 0]
        if any(not set().union(*grams) for grams, _ in open_):
            return []
    return chosen


def has_mark(text: Column, marks: list[str]) -> Column:
    """Whether the text, in lower case, has a mark; it is bound once (a lambda), not for each mark."""

    def found(low: Column) -> Column:
        return reduce(lambda x, y: x | y, [F.contains(low, F.lit(m)) & (F.lit(True) if len(m) > 2 else low.rlike(f"(?<![a-z0-9]){m}(?![a-z0-9])")) for m in marks])

    return F.exists(F.array(F.lower(text)), found) if marks else F.lit(True)


def template_rows(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, licence, size, bigram): a row per distinct bigram of each template."""


    rows = []
    for k, (name, text) in enumerate(templates):
        words = re.findall("[a-z0-9]+", text.lower())
        grams = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
        rows += [(k, name, len(grams), g) for g in grams]
    return spark.createDataFrame(rows, "template int, licence string, size int, bigram string")


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, segment, licence, score) of matching segments; mark is a hash of the text."""
    grams = template_rows(docs.sparkSession, templates)
    sizes = [len({*zip(w, w[1:], strict=False)}) for w in (re.findall("[a-z0-9]+", t.lower()) for _, t in templates)]
    low, high = size_bounds(dice)
    least, most = min(sizes) * low, max(sizes) * high
    text = named(text_col).cast("string")
    marks = marks_of(templates, dice)
    rows = docs.filter(has_mark(text, marks)).select(identity(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    lines, parts = F.split("text", "\r?\n"), F.split("text", "\r?\n[ \t]*\r?\n")
    several = lambda pieces: F.when(F.size(pieces) > 1, pieces).otherwise(F.array().cast("array<string>"))
    segments = rows.select("id", "mark", F.posexplode(F.concat(F.array("text"), several(lines), several(parts))).alias("segment", "piece"))
    # n bigrams take n + 1 words, of one character at least and one between
    segments = segments.filter(F.length("piece") >= 2 * least + 1).filter(has_mark(F.col("piece"), marks))
    # The words of a segment are bound once (a lambda), or each bigram would cut the text anew.
    cut = F.array(F.regexp_extract_all(F.lower("piece"), F.lit("[a-z0-9]+"), F.lit(0)))

    def pairs(words):
        return F.array_distinct(F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1))))

    found = segments.select("id", "mark", "segment", F.get(F.transform(cut, pairs), F.lit(0)).alias("grams")).filter(F.size("grams").between(least, most))
    found = found.select("id", "mark", "segment", F.size("grams").alias("own"), F.explode("grams").alias("bigram"))
    shared = found.join(F.broadcast(grams), "bigram").filter(F.col("own").between(F.col("size") * low, F.col("size") * high))
    counted = shared.groupBy("id", "mark", "segment", "template", "licence", "own", "size").agg(F.count_distinct("bigram").alias("both"))
    scored = counted.withColumn("score", 2.0 * F.col("both") / (F.col("own") + F.col("size"))).filter(F.col("score") >= dice)
    best = scored.groupBy("id", "mark", "segment").agg(F.max(F.struct("score", (-F.col("template")).alias("minus"), "licence")).alias("best"))
    return best.select("id", "mark", "segment", "best.licence", "best.score")


def passages(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, passages): licence and score of the windows that count, in order of the text."""
    low, high = size_bounds(dice)
    lengths = [len(re.findall("[a-z0-9]+", t.lower())) - 1 for _, t in templates]
    grams = template_rows(docs.sparkSession, templates).withColumn("span", (F.get(F.array(*map(F.lit, lengths)), F.col("template")) * high).cast("int")).withColumn("code", F.hash("bigram"))
    text = named(text_col).cast("string")
    words = F.array(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    pairs = F.get(F.transform(words, lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))), F.lit(0))
    # repeated rows are one text
    some = docs.filter(has_mark(text, marks_of(templates, dice)))
    rows = some.select(identity(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.posexplode(pairs).alias("pos", "bigram"))
    hits = rows.join(F.broadcast(grams), "bigram").groupBy("id", "mark", "template", "licence", "size", "span").agg(F.array_sort(F.collect_set(F.struct("pos", "code"))).alias("hits"))
    hits = hits.filter(F.size("hits") >= F.col("size") * low).filter(F.size(F.array_distinct("hits.code")) >= F.col("size") * low)

    def best_from(start):
        def step(state, hit):
            seen = F.when(F.array_contains(state["seen"], hit["code"]), state["seen"]).otherwise(F.array_append(state["seen"], hit["code"]))
            n, both = state["n"] + 1, F.size(seen)
            own = both + (hit["pos"] - start["pos"] + 1 - n)
            new = F.struct((2.0 * both / (own + F.col("size"))).alias("score"), both.alias("both"), start["pos"].alias("start"), hit["pos"].alias("end"))
            return F.struct(seen.alias("seen"), n.alias("n"), F.greatest(state["best"], new).alias("best"))

        zero = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(0).alias("n"), F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("both"), F.lit(0).alias("start"), F.lit(0).alias("end")).alias("best"))
        return F.aggregate(F.filter("hits", lambda h: (h["pos"] >= start["pos"]) & (h["pos"] < start["pos"] + F.col("span"))), zero, step, lambda state: state["best"])

    # a window has `need` hits, so from its first the need-th is within reach
    need = F.ceil(F.col("size") * low).cast("int")
    starts = F.filter("hits", lambda h, i: F.get("hits", i + need - 1)["pos"] < h["pos"] + F.col("span"))
    found = hits.withColumn("starts", starts).filter(F.size("starts") > 0).withColumn("best", F.array_max(F.transform("starts", best_from))).filter(F.col("best.score") >= dice)
    item = F.struct("best.start", "best.end", F.struct("best.both", "best.score", (-F.col("template")).alias("minus")).alias("rank"), "licence")
    own = found.groupBy("id", "mark").agg(F.array_sort(F.collect_list(item)).alias("all"))
    stays = lambda w: ~F.exists("all", lambda o: (o["start"] <= w["end"]) & (o["end"] >= w["start"]) & (o["rank"] > w["rank"]))
    return own.select("id", "mark", F.transform(F.filter("all", stays), lambda w: F.struct(w["licence"].alias("licence"), w["rank"]["score"].alias("score"))).alias("passages"))


def whole_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """As `scan`, with the licences that are only found inside a longer text."""
    inside = passages(docs, id_col=id_col, text_col=text_col, **options)
    found = matches(docs, id_col=id_col, text_col=text_col, **options)
    names = inside.select("id", "mark", F.posexplode("passages").alias("at", "p")).select("id", "mark", "at", "p.licence", "p.score")
    # of segments (inside false) and windows
    both = found.select("id", "mark", F.lit(False).alias("inside"), F.col("segment").alias("at"), "licence", "score").unionByName(names.select("id", "mark", F.lit(True).alias("inside"), "at", "licence", "score"))
    by_name = both.groupBy("id", "mark", "licence").agg(F.count_if(~F.col("inside")).alias("n"), F.min(F.struct("inside", (-F.col("score")).alias("minus"), "at")).alias("first"))
    per_doc = by_name.groupBy("id", "mark").agg(
        F.min_by("licence", "first").alias("licence"), F.min("first").getField("minus").alias("minus"), F.sum(F.greatest("n", F.lit(1))).alias("n_matches"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
    )
    rows = docs.select(identity(id_col).alias("id"), F.xxhash64(named(text_col).cast("string")).alias("mark"))
    out = rows.join(per_doc, ["id", "mark"], "left")
    return out.select(F.when(F.col("id") < NULL_ID, F.col("id")).alias("doc_id"), "licence", F.round(F.coalesce(-F.col("minus"), F.lit(0.0)), 6).alias("score"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("licences", F.lit("")).alias("licences"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, licence (of the best segment), score, n_matches, licences (all, sorted)."""
    found = matches(docs, id_col=id_col, text_col=text_col, **options)
    per_doc = found.groupBy("id", "mark").agg(
        F.max_by("licence", F.struct("score", (-F.col("segment")).alias("minus"))).alias("licence"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_matches"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
    )
    rows = docs.select(identity(id_col).alias("id"), F.xxhash64(named(text_col).cast("string")).alias("mark"))
    out = rows.join(per_doc, ["id", "mark"], "left")
    return out.select(F.when(F.col("id") < NULL_ID, F.col("id")).alias("doc_id"), "licence", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("licences", F.lit("")).alias("licences"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n".join(f"({k}, {quote(n)}, {quote(t)})" for k, (n, t) in enumerate(TEMPLATES))
    low, high = size_bounds(DICE)
    return f"""
with templates(template, licence, body) as (values {values}),
bigrams(k, words) as (select template, regexp_extract_all(lower(body), '[a-z0-9]+') from templates),
tg as (select distinct k as template, words[i] || ' ' || words[i + 1] as bigram from (select k, words, unnest(range(1, len(words))) as i from bigrams)),
ts as (select template, count(*) as size from tg group by 1),
pieces as (
  select doc_id, 0 as segment, text as piece from documents
  union all select doc_id, i, lines[i] from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split_regex(text, '\r?\n') as lines from documents) where len(lines) > 1)
  union all select doc_id, 1000000 + i, parts[i] from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, string_split_regex(text, '\r?\n[ \t]*\r?\n') as parts from documents) where len(parts) > 1)
), w as (select doc_id, segment, regexp_extract_all(lower(piece), '[a-z0-9]+') as words from pieces),
g as (select distinct doc_id, segment, words[i] || ' ' || words[i + 1] as bigram from (select doc_id, segment, words, unnest(range(1, len(words))) as i from w where len(words) > 1)),
own as (select doc_id, segment, count(*) as own from g group by 1, 2),
both_ as (select doc_id, segment, template, count(*) as shared from g join tg using (bigram) group by 1, 2, 3),
scored as (select doc_id, segment, template, 2.0::double * shared / (own + size) as score from both_ join own using (doc_id, segment) join ts using (template)
  where own between size * {low!r}::double and size * {high!r}::double and 2.0::double * shared / (own + size) >= {DICE!r}::double),
best as (select *, row_number() over (partition by doc_id, segment order by score desc, template) as r from scored),
named as (select doc_id, segment, licence, score from best join templates using (template) where r = 1),
per_doc as (select doc_id, first(licence order by score desc, segment) as licence, max(score) as score, count(*) as n_matches, string_agg(distinct licence, ',' order by licence) as licences from named group by 1)
select doc_id, licence, round(coalesce(score, 0), 6) as score, cast(coalesce(n_matches, 0) as bigint) as n_matches, coalesce(licences, '') as licences
from documents left join per_doc using (doc_id)
"""


ORACLE = {"op5_licence_scan": _oracle()}
