"""Licence scans: windows of normalised text against licence templates by the Dice coefficient of their word bigrams.

A text is one run of words a-z and digits, so comment marks, line breaks and indentation don't matter. A window that reaches
the coefficient t with a template of n distinct bigrams has between n * t / (2 - t) and n * (2 - t) / t of them, and shares at
least n * t / (2 - t): it holds one of any n - ceil(n * t / (2 - t)) + 1 of the template's bigrams. That many of the rarest (the
longest; ties by the alphabet) are its anchors. Every anchor in a text places a window of the template's length, aligned at the
anchor, and only those windows are compared: texts without an anchor, and templates whose size bounds a window doesn't fit, are
left out. Windows are cut inside the row, so no whole text is copied for a candidate, and the templates are a constant of
some 60 rows: the one shuffle moves the documents' matches.

A licence that states a version or a kind within a common wording has required bigrams (``REQUIRED``); a window without
those of its template is no match, so that one version isn't taken for another.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _gnu(name: str, version: str, day: str) -> tuple[str, ...]:
    """The notice that the licence asks for, its first paragraph, the title of the licence text, and a mention by name."""
    grant = f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the
        Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
    return (
        f"{name}, version {version}", grant,
        f"""{grant} This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.""",
        f"""{name} Version {version}, {day} Everyone is permitted to copy and distribute verbatim copies of this license document, but
        changing it is not allowed.""",
    )


# Licence texts and notices as their publishers word them.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
    files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
    modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
    is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
    included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
    WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
    OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
    NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
    OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
    NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
    CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
    NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
    compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
    non-commercial, and by any means."""
_UNLICENSE_LAW = """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
    interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment
    of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
    rights to this software under copyright law."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
    damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
    commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
    software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
    product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must
    be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
    altered from any source distribution."""
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND
        DISTRIBUTION""",
    ),
    "MIT": ("under the MIT License.", "The MIT License (MIT)", _MIT_GRANT, _MIT_WARRANTY, f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    "BSD-2-Clause": (_BSD_TWO, _BSD_WARRANTY, f"{_BSD_TWO} {_BSD_WARRANTY}"),
    "BSD-3-Clause": (_BSD_THIRD,),
    "ISC": (_ISC_GRANT, f"{_ISC_GRANT} {_ISC_WARRANTY}"),
    "Unlicense": (_UNLICENSE, _UNLICENSE_LAW, f"{_UNLICENSE} {_UNLICENSE_LAW} {_MIT_WARRANTY}"),
    "Zlib": (_ZLIB,),
    "GPL-2.0": ("GPL 2.0", *_gnu("GNU General Public License", "2", "June 1991")),
    "GPL-3.0": ("GPL 3.0", *_gnu("GNU General Public License", "3", "29 June 2007")),
    "LGPL-2.1": ("LGPL 2.1", *_gnu("GNU Lesser General Public License", "2.1", "February 1999")),
    "LGPL-3.0": ("LGPL 3.0", *_gnu("GNU Lesser General Public License", "3", "29 June 2007")),
    "AGPL-3.0": ("AGPL 3.0", *_gnu("GNU Affero General Public License", "3", "19 November 2007")),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "CC0-1.0": (
        "CC0 1.0 Universal",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
    ),
    "CC-BY-4.0": ("under a Creative Commons Attribution 4.0 International License.", "under CC BY 4.0."),
    "CC-BY-SA-4.0": ("under a Creative Commons Attribution-ShareAlike 4.0 International License.", "under CC BY-SA 4.0."),
    "CC-BY-NC-4.0": ("under a Creative Commons Attribution-NonCommercial 4.0 International License.", "under CC BY-NC 4.0."),
    "All-Rights-Reserved": ("All rights reserved.",),
}
# every licence but the last is also named by its identifier
TEMPLATES = {name: (*texts, f"SPDX-License-Identifier: {name}") if name != "All-Rights-Reserved" else texts for name, texts in TEMPLATES.items()}
REQUIRED = {
    "GPL-2.0": ("gnu general", "version 2"), "GPL-3.0": ("gnu general", "version 3"), "LGPL-2.1": ("gnu lesser", "2 1"),
    "LGPL-3.0": ("gnu lesser", "version 3"), "AGPL-3.0": ("gnu affero", "version 3"), "CC-BY-4.0": ("attribution 4", "by 4"),
    "CC-BY-SA-4.0": ("attribution sharealike", "by sa"), "CC-BY-NC-4.0": ("attribution noncommercial", "by nc"),
}
WORD = "[a-z0-9]+"


class Template(NamedTuple):
    licence: str
    width: int  # words
    pairs: list[str]  # distinct bigrams
    required: list[str]
    anchors: list[tuple[str, int]]  # bigram and its place, for every place


def known_templates(templates: Mapping[str, tuple[str, ...]] = TEMPLATES, required: Mapping[str, tuple[str, ...]] = REQUIRED, least: float = 0.8) -> list[Template]:
    """The templates with their anchors; a constant of the scan, whatever the documents."""
    known = []
    for licence, texts in templates.items():
        for text in texts:
            words = re.findall(WORD, text.lower())
            run = [f"{a} {b}" for a, b in zip(words, words[1:])]
            pairs = sorted(set(run))
            n_anchors = len(pairs) - math.ceil(len(pairs) * least / (2 - least) - 1e-9) + 1
            rarest = set(sorted(pairs, key=lambda pair: (-len(pair), pair))[:n_anchors])
            known.append(Template(licence, len(words), pairs, [x for x in required.get(licence, ()) if x in pairs], [(x, i) for i, x in enumerate(run) if x in rarest]))
    return known


def normalised(text: Column) -> Column:
    """Lower-case words of letters a-z and digits, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _pair(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words, each joined by a space."""
    return _let(words, lambda w: F.array_distinct(
        F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: _pair(w, i)))))


def windows(docs: DataFrame, known: list[Template]) -> DataFrame:
    """(row, doc_id, template, start, words): the distinct windows that the anchors in a text place, cut at the text's ends."""
    places: dict[str, list[dict[str, int]]] = {}
    for number, template in enumerate(known):
        for pair, offset in template.anchors:
            places.setdefault(pair, []).append({"template": number, "offset": offset})
    firsts = sorted({pair.split(" ")[0] for pair in places})
    where = F.from_json(F.lit(json.dumps(places)), "map<string,array<struct<template:int,offset:int>>>")
    width = F.array(*[F.lit(template.width) for template in known])

    def hits(w: Column) -> Column:
        at = F.when(F.size(w) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(w) - 2))
        return F.filter(at, lambda i: F.get(w, i).isin(firsts) & _pair(w, i).isin(sorted(places)))

    def starts(w: Column, found: Column) -> Column:
        # most texts have no anchor: the table of places is not touched for them
        return F.when(F.size(found) > 0, _let(where, lambda table: F.array_distinct(F.flatten(F.transform(found, lambda i: F.transform(
            table[_pair(w, i)], lambda x: F.struct(x["template"].alias("template"), F.greatest(F.lit(0), i - x["offset"]).alias("start"))))))))

    def cut(w: Column) -> Column:
        return F.transform(_let(hits(w), lambda found: starts(w, found)), lambda x: F.struct(
            x["template"].alias("template"), x["start"].alias("start"), F.slice(w, x["start"] + 1, F.get(width, x["template"])).alias("words")))

    keyed = docs.where(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return keyed.select("row", "doc_id", F.inline(_let(normalised(F.col("text")), cut)))


def licence_matches(docs: DataFrame, *, least: float = 0.8, templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
                    required: Mapping[str, tuple[str, ...]] = REQUIRED) -> DataFrame:
    """(row, doc_id, licence, template, start, dice): windows whose coefficient with a template is ``least`` or more.

    ``start`` is the number of the window's first word, from 0. An anchor that is shifted by inserted words places a window of its
    own, so one notice may have several rows.
    """
    known = known_templates(templates, required, least)
    rows = [(i, x.licence, len(x.pairs), x.pairs, x.required) for i, x in enumerate(known)]
    table = docs.sparkSession.createDataFrame(rows, "template int, licence string, size int, known array<string>, required array<string>")
    reach = least / (2 - least)
    cut = windows(docs, known).select("row", "doc_id", "template", "start", bigrams(F.col("words")).alias("pairs")).withColumn("n", F.size("pairs"))
    fits = cut.join(F.broadcast(table), "template").where(F.col("n").between(F.col("size") * reach - 1e-9, F.col("size") / reach + 1e-9))
    dice = 2 * F.size(F.array_intersect("pairs", "known")) / (F.col("n") + F.col("size"))
    whole = F.size(F.array_except("required", "pairs")) == 0
    return fits.where(whole).withColumn("dice", dice).where(F.col("dice") >= least).select("row", "doc_id", "licence", "template", "start", "dice")


def licences(docs: DataFrame, *, least: float = 0.8, templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
             required: Mapping[str, tuple[str, ...]] = REQUIRED) -> DataFrame:
    """Documents with a licence: doc_id, n_templates (different templates found), licences (sorted, comma-joined), best_permille.

    One row for each row of ``docs`` with a match. A text may hold several licences and names each; the three BSD clauses name
    the licence of two as well. Null and empty texts have none; texts of any length are read whole; repeated rows are reported
    each; of equal coefficients any gives the same result; an empty table gives an empty one. Columns other than doc_id and text are ignored.
    """
    found = licence_matches(docs, least=least, templates=templates, required=required)
    return found.groupBy("row", "doc_id").agg(
        F.count_distinct("template").alias("n_templates"), F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"),
        F.round(F.max("dice") * 1000).cast("long").alias("best_permille")).drop("row")
