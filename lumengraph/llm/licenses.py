"""Licence scan by Dice coefficient over word bigrams.

A document's lines, its whole text and windows of its words are normalised (A-Z
lower-cased, anything but letters and digits is a space) and compared with a
catalogue of notices and full licence texts.  Both sides are sets of distinct
bigrams, and so are the bounds on their sizes: a coefficient that reaches the
threshold needs sets of close sizes.

Windows are searched where no line matches, across line ends, unless the whole text
matches.  Of all windows only those from the start of a run of a template's bigrams
to the end of one are built: a window with anything else at an end gains by losing
it, and one that stops inside a run gains by going on.  Of matching windows that
share a word the best one counts.

Every match holds enough of its template's bigrams to touch one of the words in
:func:`keywords`; texts and lines without such a word build no bigrams at all.  The
catalogue is part of the plan: its size is that of the list below, not of the data.

Everything is DataFrame expressions: no Python runs on the rows.

Defined results: null, empty and wordless texts match nothing; equal lines count
each; ties between templates go to the smaller licence name; repeated rows
give one row each; a null doc_id is kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER

#: Fixed values: (licence, text as it is stated in works under it).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Full texts, without their copyright lines; those of CC-BY-4.0 and CC-BY-NC-4.0 are missing.
FULL_TEXTS = tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
TERM = "[a-z0-9]+"
#: Words that select nothing ("mit" is German for with).
COMMON = frozenset("a all an and any are as at be by can for from in is it its may mit no not of on only or other shall such that the their this to under use when which will with you your".split())


def bigrams_of(text: str) -> tuple[list[str], int]:
    """Distinct bigrams and the number of words of a template."""
    words = re.findall(TERM, text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])}), len(words)


def keywords(grams: list[str], need: int) -> set[str]:
    """Words of a template of which ``need`` of its bigrams must touch at least one."""
    chosen: set[str] = set()
    left = set(grams)
    while left and len(left) >= need:
        touched = Counter(w for g in left for w in set(g.split(" ")))
        chosen.add(max(touched, key=lambda w: (w not in COMMON and len(w) > 1, touched[w], len(w), w)))
        left = {g for g in left if not chosen & set(g.split(" "))}
    return chosen


def _let(value: Column, use) -> Column:
    """``use(value)``, worked out once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def match_licenses(docs: DataFrame, min_dice: float = 0.8, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES + FULL_TEXTS) -> DataFrame:
    """One row per document: ``doc_id, n_matches, license, dice, matches``.

    ``matches`` holds ``license, dice`` of the best template of each matching line,
    of the whole text if it has several lines, and of each matching window;
    ``license`` and ``dice`` are the best of them.
    """
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    known = [(name, grams) for name, text in sorted(templates) if (grams := bigrams_of(text)[0])]
    marks = sorted(set().union(*[keywords(grams, math.ceil(len(grams) * low - 1e-9)) for _, grams in known]))
    # by first letter, so that few branches are tried at each word
    branches = "|".join(f"{a}(?:{'|'.join(w[1:] for w in marks if w[0] == a)})" for a in sorted({w[0] for w in marks}))
    marked = lambda s: s.rlike(rf"(?i)(?:^|[^a-z0-9])(?:{branches})(?![a-z0-9])")
    catalogue = F.array(*[F.struct(F.lit(name).alias("license"), F.split(F.lit("|".join(grams)), r"\|").alias("grams"), F.lit(len(grams)).alias("n")) for name, grams in known])
    listed = lambda s: _let(F.regexp_extract_all(s, F.lit(TERM), F.lit(0)), lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    pairs = lambda s: F.filter(listed(s), lambda g: g.isNotNull())

    def best(segment: Column) -> Column:
        def of(grams: Column) -> Column:
            near = F.filter(catalogue, lambda t: F.size(grams).between(t["n"] * low - 1e-9, t["n"] * high + 1e-9))
            dice = lambda t: F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])
            return F.array_min(F.filter(F.transform(near, lambda t: F.struct((-dice(t)).alias("minus"), t["license"].alias("license"))), lambda m: m["minus"] <= -min_dice))

        return F.when(marked(segment), _let(F.array_distinct(pairs(segment)), of))

    window = "array<struct<minus:double,license:string,first:int,last:int>>"

    def of_template(grams: Column, t: Column) -> Column:
        """All windows from the start of a run to the end of one that reach the threshold."""

        def of_runs(at: Column) -> Column:
            ends = F.transform(at, lambda p, k: F.struct(p.alias("at"), k.alias("nth"), F.coalesce(F.get(at, k - 1) != p - 1, F.lit(True)).alias("opens"), F.coalesce(F.get(at, k + 1) != p + 1, F.lit(True)).alias("closes")))
            return _let(ends, lambda e: F.flatten(F.transform(F.filter(e, lambda x: x["opens"]), lambda s: from_start(e, s))))

        def from_start(ends: Column, s: Column) -> Column:
            far = F.filter(ends, lambda x: x["closes"] & (x["nth"] - s["nth"] + 1 >= t["n"] * low - 1e-9))

            def step(state: Column, e: Column) -> Column:
                def judged(own: Column) -> Column:
                    def scored(shared: Column) -> Column:
                        dice = F.lit(2.0) * shared / (F.size(own) + t["n"])
                        found = F.array(F.struct((-dice).alias("minus"), t["license"].alias("license"), s["at"].alias("first"), e["at"].alias("last"))).cast(window)
                        # foreign bigrams only grow in number from here on
                        over = F.size(own) - shared > t["n"] * (high - 1) + 1e-9
                        return F.struct(over.alias("over"), F.when(dice >= min_dice, F.concat(state["found"], found)).otherwise(state["found"]).alias("found"))

                    return _let(F.size(F.array_intersect(own, t["shared"])), scored)

                return F.when(state["over"], state).otherwise(_let(F.array_distinct(F.slice(grams, s["at"] + 1, e["at"] - s["at"] + 1)), judged))

            return F.aggregate(far, F.struct(F.lit(False).alias("over"), F.array().cast(window).alias("found")), step, lambda state: state["found"])

        return _let(F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["shared"], g), i)), lambda i: i.isNotNull()), of_runs)

    def windows(block: Column) -> Column:
        def of(grams: Column) -> Column:
            shared = lambda d: F.transform(catalogue, lambda t: F.struct(t["license"].alias("license"), t["n"].alias("n"), F.array_intersect(d, t["grams"]).alias("shared")))
            held = F.filter(_let(F.array_distinct(grams), shared), lambda t: F.size(t["shared"]) >= t["n"] * low - 1e-9)
            found = F.array_sort(F.flatten(F.transform(held, lambda t: of_template(grams, t))))
            apart = lambda kept, m: ~F.exists(kept, lambda k: (k["first"] <= m["last"] + 1) & (m["first"] <= k["last"] + 1))
            return F.aggregate(found, F.array().cast(window), lambda kept, m: F.when(apart(kept, m), F.concat(kept, F.array(m))).otherwise(kept))

        return F.transform(_let(pairs(block), of), lambda m: F.struct(m["minus"].alias("minus"), m["license"].alias("license")))

    match = "array<struct<minus:double,license:string>>"
    raw = F.coalesce(F.col(text_col), F.lit(""))
    # \x01 is no letter or digit; below it stands for a line that matches
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(marked(raw), F.translate(raw, UPPER + "\x01", UPPER.lower() + " ")).alias("text"))
    rows = rows.withColumn("lines", F.split("text", "\n"))
    rows = rows.withColumn("of_lines", F.transform("lines", best)).withColumn("whole", F.when(F.size("lines") > 1, best(F.col("text"))))
    blocks = F.split(F.array_join(F.zip_with("lines", "of_lines", lambda line, m: F.when(m.isNull(), line).otherwise(F.lit("\x01"))), "\n"), "\x01")
    rows = rows.withColumn("windows", F.when(F.col("whole").isNull(), F.flatten(F.transform(F.filter(blocks, marked), windows))))
    none = F.array().cast(match)
    rows = rows.select("doc_id", F.filter(F.concat(F.coalesce("of_lines", none), F.array("whole").cast(match), F.coalesce("windows", none)), lambda m: m.isNotNull()).alias("best"))
    top = F.array_min("best")
    return rows.select(
        "doc_id", F.size("best").cast("long").alias("n_matches"), top["license"].alias("license"), F.round(-top["minus"], 6).alias("dice"),
        F.transform("best", lambda m: F.struct(m["license"].alias("license"), F.round(-m["minus"], 6).alias("dice"))).alias("matches"),
    )
