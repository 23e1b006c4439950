"""Licence scan in DataFrame expressions only: passages against templates by Dice coefficient over word bigrams.

The lines, paragraphs and sentences of a text are normalised to lower-case words. With b different bigrams a passage can
reach the coefficient t against a template of n only if b lies between n t / (2 - t) and n (2 - t) / t, and shares n t / (2 - t)
bigrams with it at least. So it must hold one of a few words of the template, which together stand in more bigrams than
may be missing: texts and passages without such a word are left at once, most others after counting words, and the rest
meets only the templates of its size. All work is inside the row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
_WORD = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"
#: Notices in common use and the telling paragraphs of licence texts, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
             "arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced in any form without the prior written permission of the publisher."),
)


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+(?:\.\d+)*", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Numbers of bigrams that can reach the threshold against ``n``."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def telling_words(grams: Sequence[str], threshold: float) -> list[str]:
    """The longest words of a template, as many as stand in more of its bigrams than a passage at the threshold can lack."""
    spare, found = len(grams) - bounds(len(grams), threshold)[0], []
    for word in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (-len(w), w)):
        if sum(not set(found).isdisjoint(g.split(" ")) for g in grams) > spare:
            break
        found.append(word)
    return found


def _pieces(passages: Column, pattern: str, among: Callable[[Column], Column]) -> Column:
    """The sentences of those passages that have several."""
    split = F.transform(passages, lambda p: F.filter(F.split(p, pattern, -1), lambda s: s != ""))
    return F.filter(F.flatten(F.filter(split, lambda s: F.size(s) > 1)), among)


def _best(grams: Column, table: Column) -> Column:
    """The best (score, licence) of a passage's bigrams among the templates of its size, or null."""
    fitting = F.filter(table, lambda t: (F.size(grams) >= t["least"]) & (F.size(grams) <= t["most"]))
    return F.array_max(F.transform(fitting, lambda t: F.struct(
        (2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))).alias("score"), t["name"].alias("name"))))


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: Sequence[tuple[str, str]] = TEMPLATES,
                 threshold: float = THRESHOLD) -> DataFrame:
    """What every row's text says of its licence: doc_id, n_notices, licenses, best_license, best_score.

    A notice is a line, a paragraph of several lines, or a sentence that is neither (of several in a line, or running over
    lines), whose coefficient with some template is at least ``threshold``; its licence is that of the best template, of equal ones the last by name. ``licenses`` lists the
    different ones in order, joined by commas, empty if there are none; ``best_license`` and ``best_score`` are then
    null. Null and empty texts have no notices; other columns are not looked at, and repeated rows or null
    identifiers are scanned like any other.
    """
    known = [(name, template_bigrams(t)) for name, t in templates]
    if not known or not all(g for _, g in known):
        raise ValueError("a template needs at least two words")
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, g)).alias("grams"), F.lit(bounds(len(g), threshold)[0]).alias("least"),
                 F.lit(bounds(len(g), threshold)[1]).alias("most")) for name, g in known])
    least = min(bounds(len(g), threshold)[0] for _, g in known) + 1
    most = max(bounds(len(g), threshold)[1] for _, g in known)
    telling = "|".join(re.escape(w) for w in sorted({w for _, g in known for w in telling_words(g, threshold)}, key=lambda w: (-len(w), w)))
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    told = docs.select(F.col(doc_id).alias("doc_id"), F.when(body.rlike(telling), body).otherwise("").alias("body"))
    lines = F.filter(F.split("body", "\n", -1), lambda p: p.rlike(telling))
    paragraphs = F.filter(F.split("body", r"\n[ \t\r]*\n", -1), lambda p: p.contains("\n") & p.rlike(telling))
    cut = told.select("doc_id", lines.alias("lines"), paragraphs.alias("paragraphs"))
    rows = cut.select("doc_id", F.concat(
        "lines", "paragraphs", _pieces(F.col("lines"), r"[.!?][ \t\r]+", lambda s: s.rlike(telling)),
        _pieces(F.col("paragraphs"), r"[.!?][ \t\r\n]+", lambda s: s.contains("\n") & s.rlike(telling))).alias("passages"))
    # a passage of w words has at most w - 1 different bigrams, so short ones go; long ones only if they repeat none
    worded = rows.select("doc_id", F.filter("passages", lambda p: F.regexp_count(p, F.lit(_WORD)) >= least).alias("passages"))
    grams = worded.select("doc_id", F.transform(
        F.transform("passages", lambda p: F.regexp_extract_all(p, F.lit(_WORD), F.lit(0))),
        lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))))
    ).alias("grams"))
    found = grams.select("doc_id", F.filter(
        F.transform(F.filter("grams", lambda g: F.size(g) <= most), lambda g: _best(g, table)),
        lambda b: b.isNotNull() & (b["score"] >= threshold)).alias("found"))
    best = F.array_max("found")
    stay = F.monotonically_increasing_id() >= 0  # keeps filters on the outcome above the expressions
    return found.select(
        "doc_id", F.size("found").cast("bigint").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda b: b["name"]))), ",").alias("licenses"),
        F.when(stay, best["name"]).alias("best_license"), best["score"].alias("best_score"))


def license_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan of ``documents`` in SQL, every passage against every template."""
    values = ",\n  ".join(
        "('{}', [{}])".format(name, ", ".join("'" + g.replace("'", "''") + "'" for g in template_bigrams(t))) for name, t in templates)
    return rf"""
WITH t(name, grams) AS (VALUES
  {values}),
d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
o AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS passage FROM d),
m AS (SELECT doc_id, passage FROM (SELECT doc_id, unnest(regexp_split_to_array(body, '\n[ \t\r]*\n')) AS passage FROM d) q WHERE contains(passage, chr(10))),
os AS (SELECT doc_id, list_filter(regexp_split_to_array(passage, '[.!?][ \t\r]+'), lambda s: s <> '') AS pieces FROM o),
ms AS (SELECT doc_id, list_filter(regexp_split_to_array(passage, '[.!?][ \t\r\n]+'), lambda s: s <> '') AS pieces FROM m),
p AS (
  SELECT * FROM o UNION ALL SELECT * FROM m
  UNION ALL SELECT doc_id, unnest(pieces) FROM os WHERE len(pieces) > 1
  UNION ALL SELECT * FROM (SELECT doc_id, unnest(pieces) AS passage FROM ms WHERE len(pieces) > 1) q WHERE contains(passage, chr(10))),
w AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(lower(passage), '[\p{{L}}\p{{N}}]+(?:\.\p{{N}}+)*') AS words FROM p),
g AS (SELECT place, doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) > 1),
s AS (
  SELECT place, doc_id, max(struct_pack(score := 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)), name := t.name)) AS best
  FROM g, t GROUP BY place, doc_id),
f AS (
  SELECT doc_id, count(*) AS n_notices, max(best) AS best, string_agg(DISTINCT best.name, ',' ORDER BY best.name) AS licenses
  FROM s WHERE best.score >= {threshold} GROUP BY doc_id)
SELECT doc_id, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(licenses, '') AS licenses, best.name AS best_license, best.score AS best_score
FROM d LEFT JOIN f USING (doc_id)"""
