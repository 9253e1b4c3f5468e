"""License scan: passages of a text against licence templates, by Dice coefficient over word bigrams.

DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The notices and texts by which these licences are known.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is MIT licensed.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "GPL-3.0": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-2.0": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-4-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "ISC": (
        "Released under the ISC License.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
# The clauses of a family of licences, the names of its versions, and the words that set licences apart.
CC_CLAUSES = (("",), ("SA",), ("NC",), ("ND",), ("NC", "SA"), ("NC", "ND"))
CC_VERSIONS = {"3.0": ({"SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivs"}, "Unported"), "4.0": ({"SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}, "International")}
for _version, (_words, _suffix) in CC_VERSIONS.items():
    for _clauses in CC_CLAUSES:
        _short = "-".join(["BY", *filter(None, _clauses)])
        _long = "-".join(["Attribution", *(_words[c] for c in _clauses if c)])
        TEMPLATES[f"CC-{_short}-{_version}"] = (f"Licensed under CC {_short} {_version}.", f"This work is licensed under a Creative Commons {_long} {_version} {_suffix} License.")
for _name in TEMPLATES:
    TEMPLATES[_name] += (f"SPDX-License-Identifier: {_name}",)
# Pairs of words that deny what a notice says.
DENIALS = frozenset(f"{no} {verb}" for no in ("not", "never", "t") for verb in ("licensed", "released", "distributed", "under"))
TELLING = frozenset("0 1 2 3 4 5 lesser library affero sa nc nd sharealike noncommercial noderivatives noderivs".split())


def normalised(text: Column) -> Column:
    """Lower case, every run of other than letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def python_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def python_bigrams(words: list[str]) -> list[str]:
    return [" ".join(p) for p in zip(words, words[1:])]


def anchor_words(words: list[str], share: float) -> set[str]:
    """Words of which every passage that shares ``share`` of the template's distinct bigrams has at least one: longest
    words first, until the bigrams without any are too few."""
    left, out = set(python_bigrams(words)), set()
    need = math.ceil(share * len(left) - 1e-9)
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) < need:
            break
        out.add(w)
        left = {g for g in left if w not in g.split()}
    return out


def guard(words: list[str]) -> list[str] | None:
    """The telling words of a template that names a version or clause; None for others, whose numbers count paragraphs."""
    own = sorted(TELLING.intersection(words))
    return own if own and len(words) < 100 and re.search(r"license|cc0?", " ".join(words)) else None


def required(words: list[str]) -> list[str]:
    """The words that a passage must have: of an SPDX line those of the licence's identifier."""
    return sorted(set(words[3:])) if words[:3] == ["spdx", "license", "identifier"] else []


def deniable(words: list[str]) -> bool:
    """Whether a denial within a passage, or that began up to two words before it, makes it none: for short templates
    without such words of their own."""
    return len(words) < 100 and not DENIALS.intersection(python_bigrams(words))


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, n_passages, best_license, best_dice, licenses (sorted distinct), passages (license, dice, first word from 0, words).

    A text is its words, lower case, whatever lines, comment signs and punctuation stand between. A passage is a run of
    words of the template's length, or of 0.8 or 1.25 times it, anywhere: within a line, or over any number of lines. Its
    Dice coefficient is 2|A and B| / (|A| + |B|) over distinct word bigrams; a licence is found where that is at least
    ``threshold`` and, for templates that name a version or a clause, passage and template have the same TELLING words.
    Of an SPDX line all words of the identifier must be there (of an expression the first identifier counts), and no passage
    of a short template may be denied ("not licensed under").
    Each template gives its best passage (the first of equals); of passages that overlap the better one counts, then the
    first licence by name.

    Dice t needs |A and B| >= t/(2-t) |B| and |A| between t/(2-t) and (2-t)/t times |B|. So texts without any of the
    templates' anchor words are done at once, templates whose bigrams a text has too few of meet no passage of it, and
    neither do passages of another size. A best passage begins with a bigram of its template, so only those are tried.
    Templates are a literal in the plan: no join, no shuffle.

    Null and empty texts have no passage: 0, null, 0.0, empty lists. Rows are scanned each by itself, so repeated rows
    and extra columns do no harm; an empty table gives an empty result.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = sorted((name, python_words(text)) for name, texts in templates.items() for text in texts)
    if any(len(words) < 2 for _, words in known):
        raise ValueError("a template has two words at least")
    strings = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    literal, every, anchors = [], set(), set()
    for name, words in known:
        grams, telling, long = list(dict.fromkeys(python_bigrams(words))), guard(words), len(words) - 1
        every.update(grams)
        anchors |= anchor_words(words, low)
        literal.append(F.struct(
            F.lit(name).alias("name"), strings(grams).alias("grams"), F.lit(float(len(grams))).alias("n"), F.lit(math.ceil(low * len(grams) - 1e-9)).alias("need"),
            F.array(*map(F.lit, sorted({long, round(0.8 * long), round(1.25 * long)}))).alias("sizes"), F.lit(telling is not None).alias("guarded"), strings(telling).alias("telling"), strings(required(words)).alias("required"), F.lit(deniable(words)).alias("deniable")))
    words = F.split(normalised(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), " ")
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w"))
    # texts without an anchor word are empty from here on
    rows = rows.select("id", F.when(F.arrays_overlap("w", strings(sorted(anchors))), F.col("w")).otherwise(strings([])).alias("w"))
    w = F.col("w")
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    rows = rows.select("id", "w", F.when(F.size(w) > 1, pairs).otherwise(strings([])).alias("g"))
    g = F.col("g")
    rows = rows.select("id", "w", "g", F.array_intersect(g, strings(sorted(every))).alias("seen"))
    fits = F.filter(F.array(*literal), lambda t: F.size(F.array_intersect(F.col("seen"), t["grams"])) >= t["need"])
    rows = rows.select("id", "w", "g", F.when(F.size("seen") > 0, fits).otherwise(F.filter(F.array(*literal), lambda t: F.lit(False))).alias("fits"))

    def passage(t: Column, start: Column, size: Column) -> Column:
        a = F.array_distinct(F.slice(g, start, size))
        end = F.least(start + size, F.size(w))  # the passage's last word
        same = ~t["guarded"] | (F.array_sort(F.array_intersect(F.slice(w, start, end - start + 1), strings(sorted(TELLING)))) == t["telling"])
        whole = F.size(F.array_except(t["required"], F.slice(w, start, end - start + 1))) == 0
        before = F.greatest(start - 2, F.lit(1))
        denied = t["deniable"] & F.arrays_overlap(F.slice(g, before, start + size - before), strings(sorted(DENIALS)))
        dice = 2.0 * F.size(F.array_intersect(a, t["grams"])) / (F.size(a) + t["n"])
        good = F.size(a).between(t["n"] * F.lit(low), t["n"] * F.lit(high)) & (dice >= threshold) & same & whole & ~denied
        return F.when(good, F.struct((-dice).alias("d"), t["name"].alias("name"), (start - 1).alias("start"), end.alias("end")))

    def best(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.array_contains(t["grams"], F.element_at(g, i)))
        return F.array_min(F.array_compact(F.flatten(F.transform(starts, lambda s: F.transform(t["sizes"], lambda size: passage(t, s, size))))))

    found = F.when(F.size("fits") > 0, F.array_sort(F.array_compact(F.transform("fits", best))))
    rows = rows.select("id", found.alias("found"))
    none = F.filter("found", lambda h: F.lit(False))
    apart = lambda kept, h: ~F.exists(kept, lambda k: (h["start"] < k["end"]) & (h["end"] > k["start"]))
    rows = rows.select("id", F.aggregate("found", none, lambda kept, h: F.when(apart(kept, h), F.concat(kept, F.array(h))).otherwise(kept)).alias("hits"))
    plain = F.transform("hits", lambda h: F.struct(h["name"].alias("license"), (-h["d"]).alias("dice"), h["start"].cast("long").alias("start"), (h["end"] - h["start"]).cast("long").alias("words")))
    plain = F.coalesce(plain, F.array().cast("array<struct<license:string,dice:double,start:bigint,words:bigint>>"))
    rows = rows.select("id", plain.alias("passages"))
    return rows.select(
        F.col("id").alias(id_col), F.size("passages").cast("long").alias("n_passages"), F.get("passages", F.lit(0))["license"].alias("best_license"),
        F.coalesce(F.get("passages", F.lit(0))["dice"], F.lit(0.0)).alias("best_dice"), F.array_sort(F.array_distinct(F.transform("passages", lambda h: h["license"]))).alias("licenses"), "passages")
