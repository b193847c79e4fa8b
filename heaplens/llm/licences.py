"""Licence scans: normalised passages against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Wordings of public licences and of the notices that refer to them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


#: Words that tell little; they are taken only where no other is left.
COMMON = frozenset("a an and any be by for in is it of nc on or that the this to with you".split())


def _words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "), " "), lambda w: w != "")


def _plain(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w)))


def telling_words(sets: Mapping[str, list[str]], threshold: float) -> list[str]:
    """A few words one of which is in every passage that is alike to a template.

    An alike passage shares at least threshold / (2 - threshold) of a template's bigrams; words are taken, most telling first, until the
    bigrams without any of them are too few for that.
    """
    spare = {name: len(b) - math.ceil(round(len(b) * threshold / (2 - threshold), 9)) + 1 for name, b in sets.items()}
    left = {name: set(b) for name, b in sets.items()}
    words: list[str] = []
    while open_ := [name for name in sets if len(sets[name]) - len(left[name]) < spare[name]]:
        candidates = {w for name in open_ for b in left[name] for w in b.split(" ")}
        candidates = candidates - COMMON or candidates
        gain = lambda w: sum(min(spare[name], sum(w in b for b in left[name])) * len(w) ** 2 / spare[name] for name in open_)
        best = max(sorted(candidates), key=gain)
        words.append(best)
        left = {name: {b for b in own if best not in b} for name, own in left.items()}
    return words


def licence_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row and licence found in it: ``id_col``, licence, dice (the best), n_passages, n_runs.

    A document's passages are its lines, its paragraphs (parted by empty lines) and the whole text; beside these, its runs of two or more
    neighbouring lines (lines without words are passed over), which a notice wrapped over lines or of several paragraphs takes, are held against each template
    whose bigrams they can't exceed beyond the bound below. Words are lower-cased
    runs of letters and digits; a passage and a template are alike if the Dice coefficient of their sets of word bigrams
    reaches ``threshold``. n_passages counts alike passages of different text, n_runs alike runs by place; either may be 0. As 2 * min(a, b) / (a + b) bounds the coefficient of sets of a and b bigrams, passages beyond the
    sizes of all templates leave before their bigrams are made, and each of the others meets only templates within its bounds.
    By the same bound an alike passage shares so many of a template's bigrams that it holds one of a few words of it; texts
    and passages without any such word leave first. Runs are made only around lines with such a word, and only if the lines about it share so many bigrams
    with a template.
    Everything happens within the row; nothing is shuffled.

    Null and empty texts, and texts without a licence, give no row; repeated rows give repeated results; null ids stay null. Ties between licences give a
    row each. Other columns are not read.
    """
    sets = {name: sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) for name, text in templates.items() for w in [_plain(text)]}
    least = lambda n: math.ceil(n * threshold / (2 - threshold) - 1e-9)
    most = lambda n: math.floor(n * (2 - threshold) / threshold + 1e-9)
    low, high = min(least(len(b)) for b in sets.values()), max(most(len(b)) for b in sets.values())
    text = F.coalesce(F.col(text_col), F.lit(""))
    passages = F.array_distinct(F.concat(F.split(text, r"[\r\n]+"), F.split(text, r"\r?\n[ \t]*\r?\n"), F.array(text)))
    # repeated bigrams can make a passage longer than its set, so only short passages can be told by their length
    words = telling_words(sets, threshold)
    telling = lambda lowered: functools.reduce(operator.or_, [F.contains(lowered, F.lit(w)) for w in words])
    rows = docs.where(telling(F.lower(F.col(text_col))))
    lines = F.filter(F.transform(F.split(text, r"[\r\n]+"), _words), lambda w: F.size(w) > 0)
    rows = rows.select(F.col(id_col).alias("id"), lines.alias("lines"), F.filter(passages, lambda p: (F.length(p) >= 2 * low) & F.exists(F.array(F.lower(p)), telling)).alias("passages"))
    rows = _with_runs(rows, sets, words, least, most, threshold)
    rows = rows.select("id", "runs", F.transform("passages", _words).alias("passages"))
    rows = rows.select("id", "runs", F.filter("passages", lambda w: F.size(w) - 1 >= low).alias("passages"))
    rows = rows.select("id", "runs", F.transform("passages", _bigrams).alias("passages"))
    rows = rows.select("id", "runs", F.filter("passages", lambda s: (F.size(s) >= low) & (F.size(s) <= high)).alias("passages")).where((F.size("passages") > 0) | (F.size("runs") > 0))

    def found(at: int, name: str) -> Column:
        n = len(sets[name])
        good = _alike(F.filter("passages", lambda s: (F.size(s) >= least(n)) & (F.size(s) <= most(n))), sets[name], threshold)
        runs = F.transform("runs", lambda r: F.get(r, at))
        return F.struct(
            F.lit(name).alias("licence"), F.greatest(F.array_max(good), F.array_max(F.transform(runs, lambda r: r["dice"]))).alias("dice"),
            F.size(good).cast("bigint").alias("n_passages"), F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["n"]).alias("n_runs"),
        )

    rows = rows.select("id", F.explode(F.array(*[found(at, name) for at, name in enumerate(sets)])).alias("f")).where("f.dice IS NOT NULL")
    return rows.select(F.col("id").alias(id_col), "f.licence", F.round("f.dice", 9).alias("dice"), "f.n_passages", "f.n_runs")


def _alike(passages: Column, template: list[str], threshold: float) -> Column:
    """The Dice coefficients from ``threshold`` on of sets of bigrams with a template's."""
    own = F.array(*[F.lit(x) for x in template])
    return F.filter(F.transform(passages, lambda s: 2.0 * F.size(F.array_intersect(s, own)) / (F.size(s) + len(template))), lambda x: x >= threshold)


def _with_runs(rows: DataFrame, sets: Mapping[str, list[str]], words: list[str], least: Callable, most: Callable, threshold: float) -> DataFrame:
    """``rows`` with runs in place of lines: for each spot (a telling line and as many lines on both sides as a run can take), dice (the best) and n of the runs
    whose first telling line this is, by template in the order of ``sets``."""
    limit = max(most(len(b)) for b in sets.values()) + 1
    low = min(least(len(b)) for b in sets.values()) + 1
    rest = [c for c in rows.columns if c != "lines"]
    rows = rows.select(*rest, "lines", F.transform("lines", F.size).alias("sizes"), F.transform("lines", lambda w: F.arrays_overlap(w, F.array(*[F.lit(x) for x in words]))).alias("told"))
    rows = rows.select(*rest, "lines", "sizes", F.filter(F.transform("told", lambda t, k: F.when(t & (F.get("sizes", k) < limit), k)), lambda k: k.isNotNull()).alias("told"))

    def reach(k: Column, sign: int) -> Column:
        """How many lines before or after line k run to ``limit`` words with it."""
        start = F.struct(F.get("sizes", k).alias("words"), F.lit(0).alias("lines"))

        def step(acc: Column, i: Column) -> Column:
            total = acc["words"] + F.coalesce(F.get("sizes", k + sign * i), F.lit(limit))  # null beyond the first or last line
            return F.struct(F.least(total, F.lit(limit + 1)).alias("words"), (acc["lines"] + F.when(total <= limit, 1).otherwise(0)).alias("lines"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, step, lambda acc: acc["lines"])

    spot = lambda k, at: F.struct(k.alias("k"), reach(k, -1).alias("before"), reach(k, 1).alias("after"), (k - 1 - F.coalesce(F.get("told", at - 1), F.lit(-1))).alias("free"))
    rows = rows.select(*rest, "lines", F.transform("told", spot).alias("spots"))
    # told in lines of the spot: where its line is, and from where a run has it as the first telling line
    near = lambda s: F.struct(F.slice("lines", s["k"] - s["before"] + 1, s["before"] + s["after"] + 1).alias("lines"), s["before"].alias("k"), F.greatest(s["before"] - s["free"], F.lit(0)).alias("first"))
    rows = rows.select(*rest, F.transform(F.when(F.size("lines") > 1, F.col("spots")).otherwise(F.slice("spots", 1, 0)), near).alias("spots"))

    def most_words(lines: Column) -> Column:
        """The words that a run may have by the templates with which these lines share enough; null without any."""
        return F.array_max(F.flatten(F.transform(F.array(_bigrams(F.flatten(lines))), lambda around: F.array(*[
            F.when(F.size(F.array_intersect(around, F.array(*[F.lit(x) for x in b]))) >= least(len(b)), most(len(b)) + 1) for b in sets.values()
        ]))))

    rows = rows.select(*rest, F.filter(F.transform("spots", lambda s: F.struct(s["lines"].alias("lines"), s["k"].alias("k"), s["first"].alias("first"), most_words(s["lines"]).alias("most"))), lambda s: s["most"].isNotNull()).alias("spots"))

    def runs(s: Column) -> Column:
        last = F.size(s["lines"]) - 1
        ends = lambda i: F.filter(F.sequence(i, last), lambda j: (j > i) & (j >= s["k"]))
        of_start = lambda i: F.filter(F.transform(ends(i), lambda j: F.flatten(F.slice(s["lines"], i + 1, j - i + 1))), lambda w: (F.size(w) >= low) & (F.size(w) <= s["most"]))
        return F.transform(F.flatten(F.transform(F.sequence(s["first"], s["k"]), of_start)), lambda w: F.struct(F.size(w).alias("words"), _bigrams(w).alias("b")))

    def score(run: Column, template: list[str]) -> Column:
        n = len(template)
        fitting = F.filter(run, lambda r: (r["words"] <= most(n) + 1) & (F.size(r["b"]) >= least(n)) & (F.size(r["b"]) <= most(n)))
        good = _alike(F.transform(fitting, lambda r: r["b"]), template, threshold)
        return F.element_at(F.transform(F.array(good), lambda g: F.struct(F.array_max(g).alias("dice"), F.size(g).cast("bigint").alias("n"))), 1)

    scores = lambda s: F.element_at(F.transform(F.array(runs(s)), lambda run: F.array(*[score(run, b) for b in sets.values()])), 1)
    return rows.select(*rest, F.transform("spots", scores).alias("runs"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``licence_scan`` over all of ``documents``."""
    return licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql(threshold: float = 0.8) -> str:
    quoted = ", ".join("('{}', '{}')".format(n.replace("'", "''"), t.replace("'", "''")) for n, t in TEMPLATES.items())
    grams = "list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
    words = r"[x FOR x IN string_split(regexp_replace(lower({}), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'), ' ') IF x <> '']"
    return rf"""
WITH t AS (
  SELECT licence, {grams} AS b FROM (SELECT licence, {words.format("text")} AS w FROM (VALUES {quoted}) v(licence, text))
), p AS (
  SELECT DISTINCT doc_id, unnest(list_concat(string_split_regex(text, '[\r\n]+'), string_split_regex(text, '\r?\n[ \t]*\r?\n'), [text])) AS p FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT doc_id, {grams} AS b FROM (SELECT doc_id, {words.format("p")} AS w FROM p)
), m AS (
  SELECT doc_id, licence, 2.0::DOUBLE * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) AS dice, 1 AS one, 0 AS run FROM g, t
  WHERE len(g.b) BETWEEN len(t.b) / 2 AND len(t.b) * 2
), d AS (
  SELECT doc_id, text, {grams} AS b FROM (SELECT doc_id, text, {words.format("text")} AS w FROM documents)
), near AS (
  SELECT doc_id, text, max(len(t.b)) * 2 AS most FROM d, t WHERE len(list_intersect(d.b, t.b)) * 2 >= len(t.b) GROUP BY ALL
), l AS (
  SELECT doc_id, most, [x FOR x IN [{words.format("y")} FOR y IN string_split_regex(text, '[\r\n]+')] IF len(x) > 0] AS l FROM near
), starts AS (
  SELECT *, unnest(range(1, len(l))) AS i FROM l
), runs AS (
  SELECT doc_id, most, l, i, unnest(range(i + 1, least(i + most + 1, len(l)) + 1)) AS j FROM starts
), r AS (
  SELECT doc_id, len(w) AS n, {grams} AS b FROM (SELECT doc_id, most, flatten(l[i:j]) AS w FROM runs) WHERE len(w) <= most
), u AS (
  SELECT doc_id, licence, 2.0::DOUBLE * len(list_intersect(r.b, t.b)) / (len(r.b) + len(t.b)) AS dice, 0 AS one, 1 AS run FROM r, t
  WHERE len(r.b) BETWEEN len(t.b) / 2 AND len(t.b) * 2 AND r.n <= floor(len(t.b) * {2 - threshold} / {threshold} + 1e-9) + 1
)
SELECT doc_id, licence, round(max(dice), 9) AS dice, sum(one)::BIGINT AS n_passages, sum(run)::BIGINT AS n_runs FROM (FROM m UNION ALL FROM u) WHERE dice >= {threshold} GROUP BY ALL
"""
