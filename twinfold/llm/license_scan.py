"""Licence scan: windows of a text against licence templates by the Dice coefficient of word bigrams.

A text is normalised (lower case, words of letters and digits) and seen as windows of as many words
as a template has. A window's coefficient is 2 m / (a + b): m bigrams shared, a in the template, b in
the window, each distinct bigram once. Only windows that begin with a bigram of the template need a
look, as any other scores no more than the one that begins at its first shared bigram.

With a coefficient of at least t, m >= a t / (2 - t): a template is pruned unless so many of the
text's bigrams are its own, and a window unless so many of them lie within its size. Only for what
is left are sets of bigrams compared. It is one expression per row: no shuffle, no row multiplied,
and a text's work grows with its words.

Defined results: a null or empty text has no licence; of a template's windows the best counts, of
equal ones the first; a licence with several matching templates is listed for each, in the order of
the templates; rows that repeat are scanned alike; other columns pass through, but a column with the
result's name is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_DISCLAIMER = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"""
_GNU = """Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
_FREE = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version."""

# Texts, opening passages and short notices of public licences. Long licences are known
# by the passages that open them and by the notices that refer to them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _FREE.format("program", ":", "General Public License", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _FREE.format("program", ";", "General Public License", 2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA " + _GNU),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU),
    ("LGPL-2.1", _FREE.format("library", ";", "Lesser General Public License", "2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA " + _GNU),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _FREE.format("program", ":", "Affero General Public License", 3)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", _ISC + _ISC_NOTICE),
    ("ISC", _ISC + _ISC_NOTICE + _ISC_DISCLAIMER),
    ("0BSD", _ISC + "." + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_DISCLAIMER),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("Unlicense", _UNLICENSE),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "Unlicense")),
)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(text: str) -> list[str]:
    """Distinct, in order."""
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def least_shared(a: int, least: float) -> int:
    """Bigrams that a window must share with a template of ``a`` to reach the coefficient."""
    return max(1, math.ceil(a * least / (2 - least) - 1e-9))


def quoted(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def let(name: str, value: str, use: str) -> str:
    """``use`` of a value that is found once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def best_window(name: str, k: int, n: int, grams: list[str], least: float) -> str:
    """The best window of template k, or null, from the text's words t.w and the hits f.h."""
    need = least_shared(len(grams), least)
    inside = f"slice(t.w, own[i].p + 1, {n})"
    distinct = let("v", inside, "size(array_distinct(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (a, b) -> concat_ws(' ', a, b))))")
    shared = f"size(array_distinct(transform(filter(slice(own, i + 1, {n - 1}), x -> x.p <= own[i].p + {n - 2}), x -> x.g)))"
    dice = let("m", shared, f"CASE WHEN m >= {need} THEN named_struct('dice', 2.0D * m / ({distinct} + {len(grams)}), 'back', -own[i].p) END")
    # so many of the template's bigrams must lie within a window
    starts = f"filter(sequence(0, size(own) - {need}), i -> own[i + {need - 1}].p - own[i].p <= {n - 2})"
    own = f"filter(f.h, x -> x.g IN ({quoted(grams)}))"
    top = let("own", own, f"CASE WHEN size(own) >= {need} THEN array_max(transform({starts}, i -> {dice})) END")
    return let("b", top, f"CASE WHEN b.dice >= {least}D THEN named_struct('license', {quoted([name])}, 'template', {k}, 'dice', b.dice, 'start', -b.back, 'words', least({n}, size(t.w) + b.back)) END")


def scan(docs: DataFrame, text_col: str = "text", templates: tuple = TEMPLATES, least: float = LEAST_DICE, out_col: str = "licenses") -> DataFrame:
    """``docs`` with ``licenses``: structs (license, template, dice, start, words) of the templates that match.

    ``start`` is the place of the window's first word among the text's, from 0.
    """
    made = [(name, k, len(words_of(t)), bigrams(t)) for k, (name, t) in enumerate(templates)]
    fewest = min(least_shared(len(b), least) for _, _, _, b in made)
    every = sorted({g for *_, b in made for g in b})
    first = sorted({g.split(" ")[0] for g in every})
    words = f"array_remove(split(lower(coalesce(`{text_col}`, '')), '[^a-z0-9]+'), '')"
    pairs = f"zip_with(t.w, slice(t.w, 2, greatest(size(t.w) - 1, 0)), (a, b) -> CASE WHEN a IN ({quoted(first)}) AND b IS NOT NULL THEN concat_ws(' ', a, b) END)"
    hits = f"filter(transform({pairs}, (g, i) -> CASE WHEN g IN ({quoted(every)}) THEN named_struct('p', i, 'g', g) END), x -> x IS NOT NULL)"
    found = f"filter(array({', '.join(best_window(*m, least) for m in made)}), x -> x IS NOT NULL)"
    scored = let("t", f"named_struct('w', {words})", let("f", f"named_struct('h', {hits})", f"CASE WHEN size(f.h) >= {fewest} THEN {found} END"))
    none = F.array().cast("array<struct<license:string,template:int,dice:double,start:int,words:int>>")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out_col.lower()]
    return docs.select(*kept, F.coalesce(F.expr(scored), none).alias(out_col))


def best_license(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, license, dice, start, n_matches) of scanned rows: the best coefficient, then the longest window, then the first template; start is -1 without one."""
    top = F.array_max(F.transform("licenses", lambda x: F.struct(x["dice"].alias("dice"), x["words"].alias("words"), (-x["template"]).alias("k"), x["license"].alias("license"), x["start"].alias("start"))))
    first = found.select(id_col, top.alias("b"), F.size("licenses").cast("long").alias("n_matches"))
    return first.select(id_col, F.col("b.license").alias("license"), F.round(F.coalesce("b.dice", F.lit(0.0)), 6).alias("dice"), F.coalesce(F.col("b.start"), F.lit(-1)).cast("long").alias("start"), "n_matches")


def op1_license_scan(spark, sf_dir):
    return best_license(scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def op1_sql(templates: tuple = TEMPLATES, least: float = LEAST_DICE) -> str:
    """The same in SQL."""
    sizes = ", ".join(f"({k}, {quoted([name])}, {len(words_of(t))}, {len(bigrams(t))}, {least_shared(len(bigrams(t)), least)})" for k, (name, t) in enumerate(templates))
    grams = ", ".join(f"({k}, {quoted([b])})" for k, (_, t) in enumerate(templates) for b in bigrams(t))
    return rf"""
WITH tpl(k, license, n, a, need) AS (VALUES {sizes}),
tg(k, gram) AS (VALUES {grams}),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM w WHERE len(w) > 1),
g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] AS gram FROM i),
h AS (SELECT g.doc_id AS doc_id, tg.k AS k, g.p AS p, g.gram AS gram FROM g JOIN tg ON tg.gram = g.gram),
c AS (SELECT doc_id, k FROM h GROUP BY doc_id, k HAVING count(*) >= (SELECT need FROM tpl WHERE tpl.k = h.k)),
o AS (SELECT h.* FROM h JOIN c ON c.doc_id = h.doc_id AND c.k = h.k),
s AS (SELECT x.doc_id AS doc_id, x.k AS k, x.p AS p, count(DISTINCT y.gram) AS m FROM o x JOIN tpl ON tpl.k = x.k JOIN o y ON y.doc_id = x.doc_id AND y.k = x.k AND y.p >= x.p AND y.p <= x.p + tpl.n - 2
  GROUP BY x.doc_id, x.k, x.p, tpl.need HAVING count(DISTINCT y.gram) >= tpl.need),
d AS (SELECT s.doc_id AS doc_id, s.k AS k, s.p AS p, m, a, license, n, count(DISTINCT g.gram) AS b FROM s JOIN tpl ON tpl.k = s.k JOIN g ON g.doc_id = s.doc_id AND g.p >= s.p AND g.p <= s.p + tpl.n - 2 GROUP BY s.doc_id, s.k, s.p, m, a, license, n),
e AS (SELECT *, 2.0::DOUBLE * m / (a + b) AS dice FROM d WHERE 2.0::DOUBLE * m / (a + b) >= {least}),
t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY dice DESC, p) = 1),
f AS (SELECT t.*, least(t.n, len(w.w) - p + 1) AS words, count(*) OVER (PARTITION BY t.doc_id) AS n_matches FROM t JOIN w ON w.doc_id = t.doc_id),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, words DESC, k) = 1)
SELECT w.doc_id AS doc_id, license, round(coalesce(dice, 0.0), 6) AS dice, coalesce(p - 1, -1)::BIGINT AS start, coalesce(n_matches, 0)::BIGINT AS n_matches FROM w LEFT JOIN u ON u.doc_id = w.doc_id
"""


OP1_SQL = op1_sql()
