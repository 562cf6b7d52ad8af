"""Licence scans in DataFrame operations alone: Dice coefficients of word bigrams.

A text is normalised (ASCII letters in lower case, all other ASCII but digits
taken as spaces) and windows of its words are compared with licence templates,
notices and whole texts alike, by the Dice coefficient of the sets of word
bigrams. A template of w words is held against windows of w words that start at
every word; a text with fewer words is one window. So a notice is found in the
middle of a line, over several lines and inside other text.

Sizes prune. With b bigrams in a template, a coefficient of t needs t * b / (2 - t)
bigrams in common: a text without so many of a template's bigrams anywhere, or a
window whose number of bigrams is out of bounds, can't match and isn't compared.
Nor are the windows that start within w // 8 words of each other where the span
that they cover together has not so many: what one window shares, its span does.

A row names its best template (by coefficient, name, then place), the first word
of that window, counted from 0, and the number of licences that match. Versions
of one licence share most of their words, so an exact copy of one may match the
others as well; the best is the copy's own. Without a match the name and the
place are null and the coefficient 0. Null and empty texts match nothing. Rows
keep their doc_id, null or repeated; no rows give no rows. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices by which licences are granted, then licence texts and headers, in natural order.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Public-Domain", "This work has been released into the public domain."),
    ("AGPL-3.0", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("Apache-2.0", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
        OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    ("BSD-2-Clause", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
        SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
        BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
        PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3.
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
        AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
        BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
        TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
        AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("GPL-2.0", """
        This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-3.0", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("ISC", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-3.0", """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later
        version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
        details."""),
    ("MIT", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
        OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
        or non-commercial, and by any means."""),
    ("Zlib", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."""),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIGNS = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum())


def words_of(text: str) -> list[str]:
    """The normalised words of a text."""
    return [w for w in text.translate(str.maketrans(_UPPER + _SIGNS, _LOWER + " " * len(_SIGNS))).split(" ") if w]


def bigrams_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def templates(threshold: float = THRESHOLD) -> list[dict]:
    """Of each template: name, words of a window, starts in a span, bigrams, least in common, most in a window."""
    out = []
    for name, text in TEMPLATES:
        words = words_of(text)
        grams = sorted(set(bigrams_of(words)))
        b = len(grams)
        need = next(i for i in range(1, b + 1) if 2.0 * i / (i + b) >= threshold)
        most = max(a for a in range(b, 4 * b + 8) if 2.0 * b / (a + b) >= threshold)
        out.append({"name": name, "words": len(words), "span": max(1, len(words) // 8), "grams": grams, "need": need, "most": most})
    return out


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, first_word and n_matches of every document."""
    known = templates(threshold)
    table = F.array(*[
        F.struct(F.lit(t["name"]).alias("name"), *(F.lit(t[k]).alias(k) for k in ("words", "span", "need", "most")), F.array(*map(F.lit, t["grams"])).alias("grams"))
        for t in known
    ])
    vocabulary = F.array(*map(F.lit, sorted({g for t in known for g in t["grams"]})))
    plain = F.translate(F.coalesce("text", F.lit("")), _UPPER + _SIGNS, _LOWER + " " * len(_SIGNS))
    words = docs.select(F.col("doc_id").cast("long"), F.filter(F.split(plain, " "), lambda x: x != "").alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = words.select("doc_id", F.when(F.size("words") < 2, F.array().cast("array<string>")).otherwise(pairs).alias("grams"))
    shared = grams.select("doc_id", "grams", F.array_intersect("grams", vocabulary).alias("shared"))
    fits = F.filter(table, lambda t: (F.size("shared") >= t["need"]) & (F.size(F.array_intersect(t["grams"], F.col("shared"))) >= t["need"]))

    def windows(t: Column) -> Column:
        """The windows of a text that match a template."""
        last = F.greatest(F.size("grams") + 1 - t["words"], F.lit(0))

        def dense(start: Column) -> Column:
            return F.size(F.array_intersect(F.slice("grams", start + 1, t["words"] + t["span"] - 2), t["grams"])) >= t["need"]

        spans = F.filter(F.sequence(F.lit(0), last, t["span"]), dense)
        starts = F.flatten(F.transform(spans, lambda start: F.sequence(start, F.least(start + t["span"] - 1, last))))

        def scored(start: Column) -> Column:
            window = F.array_distinct(F.slice("grams", start + 1, t["words"] - 1))
            dice = F.transform(
                F.array(window),
                lambda g: F.when(F.size(g).between(t["need"], t["most"]), 2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + F.size(t["grams"]))).otherwise(0.0),
            )
            return F.struct((-F.get(dice, F.lit(0))).alias("minus"), t["name"].alias("name"), start.alias("first"))

        return F.filter(F.transform(starts, scored), lambda s: s["minus"] <= -threshold)

    found = shared.select("doc_id", F.flatten(F.transform(fits, windows)).alias("found"))
    best = F.array_min("found")
    return found.select(
        "doc_id", best["name"].alias("license"), F.round(F.coalesce(-best["minus"], F.lit(0.0)), 6).alias("dice"),
        best["first"].cast("long").alias("first_word"), F.size(F.array_distinct(F.col("found")["name"])).cast("long").alias("n_matches"),
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same over the documents table, in DuckDB SQL."""
    rows = ", ".join(f"({k}, '{t['name']}', {t['words']}, {t['need']}, {t['grams']!r})" for k, t in enumerate(templates(threshold)))
    signs = _SIGNS.replace("'", "''")
    return f"""
WITH template(k, name, words, need, grams) AS (VALUES {rows}),
plain AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}{signs}', '{_LOWER}{" " * len(_SIGNS)}') AS t FROM documents),
worded AS (SELECT r, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM plain),
grams AS (SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM worded WHERE len(w) >= 2),
pairs AS (
  SELECT r, k, name, words, grams, g, greatest(len(g) + 1 - words, 0) AS last
  FROM grams JOIN template ON len(list_intersect(grams, g)) >= need),
starts AS (SELECT r, k, name, words, grams, g, unnest(range(0, last + 1)) AS s FROM pairs),
windows AS (SELECT r, name, s, grams, list_distinct(g[s + 1 : s + words - 1]) AS h FROM starts),
scored AS (SELECT r, name, s, 2.0::DOUBLE * len(list_intersect(h, grams)) / (len(h) + len(grams)) AS dice FROM windows),
best AS (SELECT r, count(DISTINCT name) AS n, min(struct_pack(minus := -dice, name := name, s := s)) AS b FROM scored WHERE dice >= {threshold!r} GROUP BY r)
SELECT doc_id::BIGINT AS doc_id, b.name AS license, round(coalesce(-b.minus, 0.0::DOUBLE), 6) AS dice, b.s::BIGINT AS first_word, coalesce(n, 0)::BIGINT AS n_matches
FROM plain LEFT JOIN best USING (r)"""
