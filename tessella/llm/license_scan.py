"""Licence notices by Dice coefficient over word bigrams, in built-in expressions only.

A text is normalised to lower-case runs of letters and digits, line ends and all,
and its windows of words are compared with licence templates by
``2 |A ∩ B| / (|A| + |B|)`` over their sets of word bigrams, so that a notice is
found however its lines are broken and whatever sentence it stands in. A window must hold
the words that tell the template's licence from its neighbours, version and variant,
each behind the word before it, and no further part of a version: another version or
variant is never taken for one that there is. A sentence that two licences share names
both. A text is looked at only if it holds one of the bigrams that any match of some
template must, and a template only if the text holds its own, so that pruning loses
nothing. A best window begins and ends with runs of the template's bigrams
and holds at most ``n (2 - threshold) / threshold`` bigrams; all such windows are
rated. Where windows overlap one that names a single licence counts, then the higher. The templates are a literal of
fixed size; the plan is one projection over the scan. Short licences are templates as whole texts, long
ones by their titles and notices.

Edge cases: a null or empty text has no licence. Ties take the longer window, then
the first licence in alphabetical order. Texts of one word have no bigram and match
nothing. Very long texts are scanned whole. Repeated rows are scanned each on its own;
an empty table gives no rows. Extra columns pass through, columns whose names clash
with those added are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names, text_or_empty

# Notices and short licence texts, each with the identifier that it names. Words in
# braces are those that tell the licence from its neighbours: a window must hold each of
# them behind the word before it. A sentence that two licences share names both.
_NOTICES: tuple[tuple[str, str], ...] = (
    ("BSD-2-Clause,BSD-3-Clause", "Redistribution and use in source and {binary forms}, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Released under the {BSD 2-Clause} License."),
    ("BSD-3-Clause", "Released under the {BSD 3-Clause} License."),
    ("BSD-4-Clause", "Released under the {BSD 4-Clause} License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby {granted. The} software is provided \"as is\" and the author disclaims all warranties with regard to this software"),
    ("CC0-1.0", "This work is dedicated to the public domain under {CC0 1.0} Universal."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights under {CC0 1.0} Universal"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby {granted, provided} that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the {ISC License}."),
    ("MIT", "Licensed under the {MIT License}."),
    ("MIT", "Released under the {MIT License}."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and {associated documentation} files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and {associated documentation} files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Unlicense", "This is free and {unencumbered software} released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or {implied warranty}. In no event will the authors be held liable for any damages arising from the use of this software."),
)

# The conditions of the licences of the Berkeley family, which differ by clause.
_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "All advertising materials mentioning features or use of this software must {display} the following acknowledgement: This product includes software developed by the organization. ",
    "Neither {the name} of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    "THIS {SOFTWARE IS PROVIDED BY} THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
)

# Versions of each licence, and the dates that stand in the titles of whole texts.
_GNU = (
    ("GPL-1.0", "General", "1", "February 1989"),
    ("GPL-2.0", "General", "2", "June 1991"),
    ("GPL-3.0", "General", "3", "29 June 2007"),
    ("LGPL-2.0", "Library General", "2", "June 1991"),
    ("LGPL-2.1", "Lesser General", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General", "3", "29 June 2007"),
    ("AGPL-3.0", "Affero General", "3", "19 November 2007"),
)
_APACHE, _MOZILLA, _COMMONS = ("1.0", "1.1", "2.0"), ("1.0", "1.1", "2.0"), ("1.0", "2.0", "2.5", "3.0", "4.0")
_COMMONS_TERMS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
_COMMONS_KINDS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")


def _templates() -> tuple[tuple[str, str], ...]:
    """The notices, and the sentences that name a licence for each of its versions and variants."""
    out = list(_NOTICES)
    shared, advertising, names, ending = _CLAUSES
    out += [("BSD-2-Clause", shared + ending), ("BSD-3-Clause", shared + names + ending), ("BSD-4-Clause", shared + advertising + names + ending)]
    for id_, name, version, date in _GNU:
        out += [
            (id_, f"This work is licensed under the GNU {{{name}}} Public License, version {{{version}}}."),
            (id_, f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {{{name}}} Public License as published by the Free Software Foundation; either version {{{version}}} of the License, or (at your option) any later version."),
            (id_, f"GNU {{{name}}} Public License Version {{{version}}}, {date}"),
        ]
    for v in _APACHE:
        out += [
            (f"Apache-{v}", f"Licensed under the {{Apache}} License, Version {{{v}}}."),
            (f"Apache-{v}", f'Licensed under the {{Apache}} License, Version {{{v}}} (the "License"); you may not use this file except in compliance with the License.'),
        ]
    out.append(("Apache-2.0", "Apache {License} Version {2.0}, January 2004"))
    for v in _MOZILLA:
        out += [
            (f"MPL-{v}", f"This Source Code Form is subject to the terms of the {{Mozilla}} Public License, v. {{{v}}}."),
            (f"MPL-{v}", f"The contents of this file are subject to the {{Mozilla}} Public License Version {{{v}}}"),
        ]
    for kind in _COMMONS_KINDS:
        terms = "-".join(_COMMONS_TERMS[k] for k in kind.split("-"))
        for v in _COMMONS:
            scope = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            out += [
                (f"CC-{kind}-{v}", f"Licensed under CC {{{kind} {v}}}."),
                (f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {{{terms} {v}}} {scope} License."),
                (f"CC-{kind}-{v}", f"creativecommons.org/licenses/{{{kind.lower()}/{v}}}"),
            ]
    return tuple(out)


#: Identifiers and marked texts.
TEMPLATES = _templates()

#: Columns that the scan adds.
RESULT = ("license_matches", "licenses", "best_license", "best_dice")

GAP = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def decisive_bigrams(text: str) -> list[str]:
    """What a window must hold: the bigrams whose second word is in braces."""
    out, before = set(), None
    for k, part in enumerate(re.split(r"[{}]", text)):
        for w in words_of(part):
            if k % 2 and before is not None:
                out.add(f"{before} {w}")
            before = w
    return sorted(out)


def excluding_bigrams(text: str) -> list[str]:
    """What a window must not hold, nor meet at its ends: a version's number with a part that the template's hasn't."""
    own, out = bigrams_of(text), set()
    for part in re.findall(r"{(\d+)}", text):
        out |= {f"{part} {k}" for k in range(1, 10)}
    if "BSD" not in text and "{SOFTWARE IS PROVIDED BY}" in text:  # whole texts without a clause that others have
        out |= {x for c in _CLAUSES[1:3] for x in decisive_bigrams(c) if x not in own}
    return sorted(out - set(own))


def required_bigram(text: str) -> str:
    """A bigram that every match holds: the longest of those that it must."""
    return max(decisive_bigrams(text), key=lambda x: (len(x), x))


def required_pattern(templates: tuple[tuple[str, str], ...]) -> str:
    """Matches any lower-case text that holds the required bigram of some template; alternatives share their first letters."""
    by_letter: dict[str, dict[str, set[str]]] = {}
    for a, b in {tuple(required_bigram(t).split()) for _, t in templates}:
        by_letter.setdefault(a[0], {}).setdefault(a[1:], set()).add(b)
    firsts = (
        re.escape(letter) + "(?:" + "|".join(re.escape(rest) + GAP + "(?:" + "|".join(map(re.escape, sorted(seconds))) + ")" for rest, seconds in sorted(words_.items())) + ")"
        for letter, words_ in sorted(by_letter.items())
    )
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(firsts)})(?![\p{{L}}\p{{N}}])"


def scan_licenses(
    df: DataFrame, threshold: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES, text: str = "text"
) -> DataFrame:
    """Add license_matches (array of struct(license, dice, unit)), licenses, best_license and best_dice."""
    known = F.array(
        *[
            F.struct(
                F.lit(name).alias("id"),
                F.lit(len(bigrams_of(t))).alias("n"),
                F.array(*map(F.lit, bigrams_of(t))).alias("b"),
                F.array(*map(F.lit, decisive_bigrams(t))).alias("must"),
                F.array(*map(F.lit, excluding_bigrams(t))).cast("array<string>").alias("never"),
                F.lit(required_bigram(t)).alias("needed"),
            )
            for name, t in templates
        ]
    )
    bound = threshold / (2 - threshold)
    df = df.drop(*[c for c in df.columns if c.lower() in RESULT and c.lower() != text.lower()])
    words_, pairs_, known_, ordered_ = free_names(df, "words", "pairs", "known", "ordered")
    low = F.lower(text_or_empty(text))
    w = F.split(F.trim(F.regexp_replace(low, GAP, " ")), " ")
    df = df.withColumn(words_, F.when(low.rlike(required_pattern(templates)), w))
    pairs = F.zip_with(words_, F.slice(words_, F.lit(2), F.size(words_)), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    df = df.withColumn(pairs_, F.array_compact(pairs)).withColumn(known_, F.when(F.col(words_).isNotNull(), known))

    def rated(t: Column) -> Column:
        """The windows of one template that reach the threshold."""
        places = F.array_compact(F.transform(pairs_, lambda x, i: F.when(F.array_contains(t["b"], x), i)))
        # Runs of shared bigrams: a window begins where one begins and ends where one ends.
        begins = lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < x - 1))
        ends = lambda p: F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + 1))
        reach = F.ceil(t["n"] / F.lit(bound)).cast("int") * 2

        def of(runs: Column) -> Column:
            def window(a: Column, z: Column) -> Column:
                b = F.array_distinct(F.slice(pairs_, a + 1, z - a + 1))
                dice = F.lit(2.0) * F.size(F.array_intersect(b, t["b"])) / (F.size(b) + t["n"])
                before = F.greatest(a, F.lit(1))
                around = F.slice(pairs_, before, z - before + 3)
                named = (F.size(F.array_intersect(b, t["must"])) == F.size(t["must"])) & ~F.arrays_overlap(around, t["never"])
                return F.struct(F.when(named, dice).alias("dice"), a.alias("a"), z.alias("z"), t["id"].alias("license"))

            return F.flatten(
                F.transform(
                    runs["begins"],
                    lambda a: F.transform(F.filter(runs["ends"], lambda z: (z >= a) & (z < a + reach) & (z - a + 1 >= t["n"] * bound - 1e-9)), lambda z: window(a, z)),
                )
            )

        bind = lambda p: F.struct(begins(p).alias("begins"), ends(p).alias("ends"))
        windows = F.flatten(F.transform(F.transform(F.array(places), bind), of))
        return F.when(F.array_contains(pairs_, t["needed"]), F.filter(windows, lambda m: m["dice"] >= threshold))

    found = F.flatten(F.array_compact(F.transform(known_, rated)))
    # Best first: those that name one licence, higher dice, longer window, licence.
    ordered = F.array_sort(
        F.transform(found, lambda m: F.struct(m["license"].contains(",").alias("shared"), (-m["dice"]).alias("least"), (m["a"] - m["z"]).alias("width"), m["license"].alias("license"), m["a"].alias("a"), m["z"].alias("z")))
    )
    df = df.withColumn(ordered_, ordered)
    kept = F.aggregate(
        ordered_,
        F.filter(ordered_, lambda m: F.lit(False)),
        lambda acc, m: F.when(F.exists(acc, lambda k: (m["a"] <= k["z"]) & (k["a"] <= m["z"])), acc).otherwise(F.concat(acc, F.array(m))),
    )
    matches = F.transform(
        kept,
        lambda m: F.struct(m["license"].alias("license"), (-m["least"]).alias("dice"), F.array_join(F.slice(words_, m["a"] + 1, m["z"] - m["a"] + 2), " ").alias("unit")),
    )
    df = df.withColumn("license_matches", F.coalesce(matches, F.expr("cast(array() AS array<struct<license:string,dice:double,unit:string>>)")))
    top = F.array_max(F.transform("license_matches", lambda m: m["dice"]))
    return df.withColumns(
        {
            "licenses": F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("license_matches", lambda m: F.split(m["license"], ","))))), ","),
            "best_dice": top,
            "best_license": F.array_min(F.transform(F.filter("license_matches", lambda m: m["dice"] == F.array_max(F.transform("license_matches", lambda k: k["dice"]))), lambda m: m["license"])),
        }
    ).drop(words_, pairs_, known_, ordered_)
