"""License notices by Dice coefficients over word bigrams, with DataFrame functions only.

A unit is a whole text, one of its lines, or a window of consecutive lines (blank ones do not count). Letters and digits are kept, in lower case; everything else is a space.
With m distinct bigrams in a template and n in a unit, the coefficient 2c/(m+n) reaches the threshold t only if
m*t/(2-t) <= n <= m*(2-t)/t; these bounds leave few templates for each unit before any bigrams are compared. The best
template of a unit is reported, the first in the alphabet among equals.

A window has two lines or more and at most as many words as the largest template's bound allows. Only texts that share
enough bigrams with some template have their windows compared. Of overlapping windows and lines the one with the
greatest coefficient is taken, then the one with fewest lines, then the first; whole texts and single lines are
reported wherever they match.

Cases: null and empty texts, and units without a bigram, match nothing. Units are found wherever they repeat, in
repeated rows too. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Short notices and headers of public licences, as they stand in documents.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


#: Texts of public licences that are short enough to be quoted whole; parts that they share are named once.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = {
    "apache-2.0-notice": NOTICES["apache-2.0-header"] + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause-text": f"{NOTICES['bsd-2-clause']} 1. {_BSD} {_BSD_END}",
    "bsd-3-clause-text": f"{NOTICES['bsd-2-clause']} 1. {_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "gpl-3.0-notice": NOTICES["gpl-3.0-header"] + " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc-text": NOTICES["isc"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit-text": f"{NOTICES['mit-permission']} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "unlicense": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} For more information, please refer to <https://unlicense.org>",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
TEMPLATES = NOTICES | TEXTS


def bigrams(text: str) -> list[str]:
    """Sorted distinct word bigrams of a template."""
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bounds(m: int, threshold: float) -> tuple[float, float]:
    """Least and greatest number of bigrams that a unit may have."""
    return m * threshold / (2 - threshold), m * (2 - threshold) / threshold


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, unit, license, dice, n): unit is -1 for the whole text, the number of a line, or -2 - line for a window.

    The line of a window is its first.
    """
    grams = {name: b for name, t in sorted(templates.items()) if (b := bigrams(t))}
    if not grams:
        return docs.sparkSession.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, unit int, license string, dice double, n int")
    limits = {name: bounds(len(b), threshold) for name, b in grams.items()}
    low, high = min(a for a, _ in limits.values()), max(b for _, b in limits.values())
    table = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(limits[n][0] - 1e-9).alias("lo"), F.lit(limits[n][1] + 1e-9).alias("hi"), F.lit(len(b)).alias("m"), F.array(*map(F.lit, b)).alias("grams")) for n, b in grams.items()])

    # `let` binds a value to a variable: an expression that is named twice would be computed twice, and inside a
    # lambda once for each template
    plain = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}\n]+", " ")
    parts = let(plain, lambda t: F.concat(F.array(F.translate(t, "\n", " ")), F.split(t, "\n", -1)))
    units = docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(parts).alias("p", "u"))

    def grams_of(w: Column) -> Column:
        # a unit of d distinct words has at least d - 1 distinct bigrams, and at most its words less one
        fits = (F.size(w) - 1 >= low - 1e-9) & (F.size(F.array_distinct(w)) - 1 <= high + 1e-9)
        pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(fits, F.array_distinct(pairs))

    def best_of(g: Column, among: Column) -> Column:
        near = F.filter(among, lambda t: (F.size(g) >= t["lo"]) & (F.size(g) <= t["hi"]))
        scored = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["m"])).alias("minus"), t["license"].alias("license"), F.size(g).alias("n")))
        return F.array_min(F.filter(scored, lambda x: x["minus"] <= -threshold + 1e-9))

    best = let(let(F.split(F.trim(F.regexp_replace("u", " +", " ")), " ", -1), grams_of), lambda g: best_of(g, table))
    found = units.select(key, (F.col("p") - 1).alias("unit"), best.alias("best")).where("best is not null")

    def pairs_of(w: Column) -> Column:
        return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))

    # a coefficient of the threshold needs as many common bigrams as the least unit has
    every = F.array(*map(F.lit, sorted({g for b in grams.values() for g in b})))
    common = lambda t: F.array_intersect(let(F.split(F.trim(F.translate(t, "\n", " ")), " +", -1), pairs_of), every)
    reached = lambda c: F.filter(table, lambda x: F.size(F.array_intersect(c, x["grams"])) >= x["lo"])
    texts = let(plain, lambda t: F.when(F.instr(t, "\n") > 0, F.filter(F.array(F.struct(t.alias("t"), let(common(t), reached).alias("near"))), lambda x: F.size(x["near"]) > 0)))
    some = docs.where(F.col(text).isNotNull()).select(F.col(key), F.explode(texts).alias("c")).select(key, "c.t", "c.near")

    def windows(rows: Column, near: Column, seen: Column) -> Column:
        """Windows from 1 line on that match: minus, lines, place and number of the first line, license, n."""

        def begins(s: Column) -> Column:
            w = F.concat(F.get(rows, s)["w"], F.coalesce(F.slice(F.get(rows, s + 1)["w"], 1, 1), F.array().cast("array<string>")))
            return F.arrays_overlap(let(w, pairs_of), seen)

        def of(s: Column) -> Column:
            def scored(k: Column) -> Column:
                w = F.flatten(F.transform(F.slice(rows, s + 1, k), lambda r: r["w"]))
                best = let(w, lambda v: F.when(F.size(v) - 1 <= high + 1e-9, let(F.array_distinct(pairs_of(v)), lambda g: best_of(g, near))))
                return let(best, lambda b: F.struct(b["minus"].alias("minus"), k.alias("k"), s.alias("s"), F.get(rows, s)["i"].alias("i"), b["license"].alias("license"), b["n"].alias("n")))

            return F.transform(F.sequence(F.lit(1), F.least(F.size(rows) - s, F.lit(int(high) + 1))), scored)

        first = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), begins)
        return F.array_sort(F.filter(F.flatten(F.transform(first, of)), lambda x: x["minus"].isNotNull()))

    def apart(found: Column) -> Column:
        clash = lambda x, y: (x["s"] < y["s"] + y["k"]) & (y["s"] < x["s"] + x["k"])
        return F.aggregate(found, F.slice(found, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: clash(x, y)), kept).otherwise(F.concat(kept, F.array(x))))

    split = F.transform(F.split("t", "\n", -1), lambda u, i: F.struct(i.alias("i"), F.filter(F.split(u, " ", -1), lambda w: w != "").alias("w")))
    seen = F.array_distinct(F.flatten(F.transform("near", lambda x: x["grams"])))
    several = lambda rows: F.filter(let(let(seen, lambda g: windows(rows, F.col("near"), g)), apart), lambda x: (x["k"] > 1) & (x["k"] < F.size(rows)))
    wrapped = some.select(key, F.explode(let(F.filter(split, lambda r: F.size(r["w"]) > 0), several)).alias("best")).select(key, (-2 - F.col("best.i")).alias("unit"), "best")
    found = found.select(key, "unit", "best.license", "best.minus", "best.n").unionAll(wrapped.select(key, "unit", "best.license", "best.minus", "best.n"))
    return found.select(key, "unit", "license", (-F.col("minus")).alias("dice"), "n")
