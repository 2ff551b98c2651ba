"""Operator 6: licence scan by Dice coefficient over word bigrams, in DataFrame functions only.

Each line, each paragraph and the whole text is lower-cased and cut into words of a-z and
0-9; its distinct word bigrams are compared with those of each template whose size leaves
the threshold within reach. So are windows of consecutive words of the text about each
template's size, around places where its bigrams stand close together: a notice inside a line, or
wrapped in a longer paragraph or comment. Texts without any of the words that a match must have
are left out first. Templates are few and fixed: literals in the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Licence notices, as they stand in public sources.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    ],
}
THRESHOLD_PERCENT = 80


def bigrams(text: str) -> list[str]:
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchors(templates: dict[str, list[str]], percent: int) -> list[str]:
    """Words of which a text has one if any unit or window of it reaches the threshold with a template.

    Dice at the threshold takes at least percent * n / (200 - percent) of a template's n
    bigrams. So of any other bigrams, one more than can be missing, one is there, and with it
    its longer word. These are taken from the bigrams with the longest words.
    """
    found: dict[str, None] = {}
    for b in (bigrams(t) for texts in templates.values() for t in texts):
        least = -(-percent * len(b) // (200 - percent))
        longer = sorted((max(x.split(), key=len) for x in b), key=lambda w: (-len(w), w))
        found |= dict.fromkeys(longer[: len(b) - least + 1])
    return sorted(found)


def _literals(templates: dict[str, list[str]], sql: str = "spark") -> str:
    rows = []
    for name, texts in templates.items():
        for b in map(bigrams, texts):
            items = ", ".join(f"'{x}'" for x in b)
            rows.append(f"named_struct('name', '{name}', 'b', array({items}), 'n', {len(b)})" if sql == "spark" else f"{{'name': '{name}', 'b': [{items}], 'n': {len(b)}}}")
    return f"array({', '.join(rows)})" if sql == "spark" else f"[{', '.join(rows)}]"


def _windows(words: str, templates: dict[str, list[str]], percent: int) -> str:
    """SQL for the best window of `_text` for each template that has one at the threshold: array of (d, name).

    m says which bigrams of the text are the template's, p where those are; pv and nx where the
    same bigram stands last before and next. The best window ends before its first bigram comes
    again, and with a bigram of the template that is new in it. So from a start s the new ones
    are counted one after the other, and a window has as many different bigrams as places, but
    for those with pv >= s. A start is looked at only if enough of the template's places follow
    within a window's length to beat the best so far, and once for equal texts of that length:
    the work grows with the text, not with the square of a notice.
    """
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    every = ", ".join(f"'{x}'" for x in dict.fromkeys(b for texts in templates.values() for t in texts for b in bigrams(t)))
    grams = "CASE WHEN size(w) > 1 THEN transform(sequence(1, size(w) - 1), i -> concat(element_at(w, i), ' ', element_at(w, i + 1))) ELSE CAST(array() AS array<string>) END"
    least = f"CAST(({percent} * t.n + {199 - percent}) div {200 - percent} AS int)"  # common bigrams that the threshold needs
    most = f"CAST({200 - percent} * t.n div {percent} AS int)"  # bigrams of the largest window within reach
    in_order = "array_sort(transform(x.g, (v, i) -> named_struct('v', v, 'i', i + 1)))"
    beside = lambda k, none: f"CASE WHEN element_at(o, {k}).v = y.v THEN element_at(o, {k}).i ELSE {none} END"
    links = f"array_sort(transform(o, (y, k) -> named_struct('i', y.i, 'b', CASE WHEN k > 0 THEN {beside('greatest(k, 1)', '0')} ELSE 0 END, 'f', CASE WHEN k + 1 < size(o) THEN {beside('least(k + 2, size(o))', '2147483647')} ELSE 2147483647 END)))"
    dice = "array_max(transform(filter(slice(p, a, c.most), j -> j < stop AND element_at(l, j).b < s), (j, k) -> 2000000L * (k + 1) div (j - s + 1 - size(filter(again, i -> i <= j)) + t.n)))"
    again = "filter(sequence(s, stop - 1), j -> element_at(l, j).b >= s)"
    one = let("element_at(p, a)", "s", let("least(s + c.most, element_at(l, s).f, size(m) + 1)", "stop", let(again, "again", dice)))
    need = "a + CAST(d * t.n div (2000000L - d) AS int)"  # the place in p that a better window from a must reach
    pick = f"(d, a) -> CASE WHEN d >= 1000000L OR {need} > size(p) THEN d WHEN element_at(p, {need}) - element_at(p, a) >= c.most THEN d ELSE greatest(d, {one}) END"
    able = "filter(sequence(1, size(p) - c.least + 1), a -> element_at(p, a + c.least - 1) - element_at(p, a) < c.most)"
    texts = f"array_sort(transform({able}, a -> named_struct('h', xxhash64(slice(x.g, element_at(p, a), c.most)), 'a', a)))"
    starts = let(texts, "r", "transform(filter(r, (y, k) -> k = 0 OR element_at(r, greatest(k, 1)).h <> y.h), y -> y.a)")
    fold = f"CASE WHEN size(p) < c.least THEN 0L ELSE aggregate(array_sort({starts}), {percent * 10_000 - 1}L, {pick}) END"
    best = let(f"named_struct('least', {least}, 'most', {most})", "c", let("transform(x.g, v -> array_contains(t.b, v))", "m", let("filter(sequence(1, size(m)), i -> element_at(m, i))", "p", fold)))
    near = f"filter({_literals(templates)}, t -> size(array_intersect(x.h, t.b)) >= {least})"  # hardly a text has so many of a template's bigrams
    each = f"filter(transform(q, t -> named_struct('d', {best}, 'name', t.name)), y -> y.d >= {percent * 10_000})"
    some = let(near, "q", f"CASE WHEN size(q) > 0 THEN {let(let(in_order, 'o', links), 'l', each)} END")
    found = let(words.replace("(u)", "(_text)"), "w", let(grams, "g", let(f"named_struct('g', g, 'h', array_intersect(g, array({every})))", "x", some)))
    return f"coalesce({found}, CAST(array() AS array<struct<d:bigint,name:string>>))"


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, percent: int = THRESHOLD_PERCENT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, licenses (array of name and dice_ppm, best first).

    dice_ppm is the highest Dice coefficient of any line, paragraph, window of words or the
    whole text with a template of the licence, in millionths, rounded down; listed from the
    threshold on. A window has at most as many bigrams as the size bound allows. Null and
    empty text: an empty array. A null id stays null, repeated rows each give a row.
    """
    sizes = [len(bigrams(t)) for texts in templates.values() for t in texts]
    least = -(-min(sizes) * percent // (200 - percent))  # fewer bigrams reach no template
    words = "filter(split(lower(u), '[^a-z0-9]+'), w -> w <> '')"
    grams = f"CASE WHEN size(w) > {least} THEN array_distinct(transform(sequence(1, size(w) - 1), i -> concat(element_at(w, i), ' ', element_at(w, i + 1)))) ELSE array() END"
    dice = "2000000L * size(array_intersect(g, t.b)) div (size(g) + t.n)"
    # Dice is at most 2 min / (min + max): templates outside these sizes are not compared
    fits = f"200 * least(size(g), t.n) >= {percent} * (size(g) + t.n)"
    found = f"filter(transform(filter({_literals(templates)}, t -> {fits}), t -> named_struct('d', {dice}, 'name', t.name)), x -> x.d >= {percent * 10_000})"
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # a text without any anchor word reaches no template: nothing of it is cut into bigrams
    some = ", ".join(f"'{x}'" for x in anchors(templates, percent))
    rows = rows.withColumn("_text", F.expr(f"CASE WHEN arrays_overlap({words.replace('(u)', '(_text)')}, array({some})) THEN _text ELSE '' END"))
    units = F.expr("array_distinct(concat(split(_text, '\\\\n'), split(_text, '\\\\n[ \\\\t]*\\\\n'), array(_text)))")
    rows = rows.withColumn("_units", units).withColumn("_grams", F.expr(f"filter(transform(transform(_units, u -> {words}), w -> {grams}), g -> size(g) >= {least})"))
    rows = rows.withColumn("_found", F.expr(f"concat(flatten(transform(_grams, g -> {found})), {_windows(words, templates, percent)})"))
    best = "transform(array_distinct(transform(_found, x -> x.name)), m -> named_struct('dice_ppm', array_max(transform(filter(_found, x -> x.name = m), x -> x.d)), 'name', m))"
    return rows.withColumn("licenses", F.expr(f"transform(array_sort({best}, (a, b) -> CASE WHEN a.dice_ppm <> b.dice_ppm THEN CAST(sign(b.dice_ppm - a.dice_ppm) AS int) WHEN a.name < b.name THEN -1 ELSE 1 END), x -> named_struct('name', x.name, 'dice_ppm', x.dice_ppm))")).select(id_col, "licenses")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.get("licenses", F.lit(0))
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", best["name"].alias("license"), best["dice_ppm"].alias("dice_ppm"), F.size("licenses").cast("long").alias("n_licenses"))


OP6_SQL = f"""
WITH t AS (SELECT unnest({_literals(TEMPLATES, 'duckdb')}) AS t),
u AS (
  SELECT DISTINCT doc_id, unnest(list_concat(string_split(coalesce(text, ''), chr(10)), regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n'), [coalesce(text, '')])) AS u FROM documents
), w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(u), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM u
), g AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1
), d AS (
  SELECT doc_id, t.name, 2000000 * len(list_intersect(g, t.b)) // (len(g) + t.n) AS d FROM g, t
  WHERE 200 * least(len(g), t.n) >= {THRESHOLD_PERCENT} * (len(g) + t.n)
), m AS (SELECT doc_id, name, max(d) AS d FROM d WHERE d >= {THRESHOLD_PERCENT * 10_000} GROUP BY ALL
), b AS (SELECT doc_id, name, d, row_number() OVER (PARTITION BY doc_id ORDER BY d DESC, name) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM m)
SELECT documents.doc_id, b.name AS license, b.d AS dice_ppm, coalesce(b.n, 0) AS n_licenses FROM documents LEFT JOIN b ON b.doc_id = documents.doc_id AND b.r = 1
"""
