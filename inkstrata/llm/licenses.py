"""License scans: MinHash bands find templates, exact shingle containment verifies them.

A template's window is as many five-word shingles long as the template. For a window,
``BANDS`` MinHash values of its shingles are taken, a band each: a window that holds
the template has the same values in all bands, one that shares the part s of their united
shingles collides with probability 1 - (1 - s)**BANDS (over 0.999 at s = 0.6, the least
that containment 0.8 leaves in a window of the template's length). Colliding windows
are verified: the part of the template's different shingles that the window has.

No window is drawn up by itself. A band collides in the windows that hold the very shingle
(the anchor) whose hash is the template's minimum and none with a smaller hash, so the
starts of such windows around an anchor are one range, whose ends are the nearest smaller
hashes on both sides. Each shingle of the template that the text has adds one to a range of starts
as well: those of the windows where it is its first occurrence. One sweep over the ends of all these
ranges gives the best start, so a template of n shingles costs n log n at an anchor. A document
without any anchor is done after one look. All of it is built-in functions. The templates are a list
given by the caller, of at most ``MAX_TEMPLATES`` and ``MAX_SHINGLES`` in all, and stand in the plan as literals.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 8
CONTAINMENT = 0.8
MAX_TEMPLATES = 1000
MAX_SHINGLES = 20_000

# Short public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-later": "either version 3 of the License, or (at your option) any later version",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "GPL-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
}

# The bodies of short public licenses and notices, whole, without their copyright lines.
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    'NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL '
    'THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES '
    '(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS '
    'INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE '
    'OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)
TEXTS = {
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        'merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is '
        'furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included '
        'in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        'IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN '
        'NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF '
        'CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ),
    "ISC-text": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided '
        'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        'DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT '
        'SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM '
        'LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN '
        'CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ),
    "BSD-2-Clause-text": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following '
        'conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the '
        'following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the '
        'following disclaimer in the documentation and/or other materials provided with the distribution.'
        " " + BSD_DISCLAIMER
    ),
    "BSD-3-Clause-text": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following '
        'conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the '
        'following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the '
        'following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the '
        'copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without '
        'specific prior written permission.'
        " " + BSD_DISCLAIMER
    ),
    "Unlicense-text": (
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, '
        'sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or '
        'non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate '
        'any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at '
        'large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in '
        'perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
        'WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        'PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN '
        'ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE '
        'SOFTWARE.'
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        'damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including '
        'commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this '
        'software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a '
        'product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must '
        'be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or '
        'altered from any source distribution.'
    ),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to '
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        'KIND, either express or implied. See the License for the specific language governing permissions and limitations under the '
        'License.'
    ),
}
GNU_NOTICE = (
    'This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free '
    'Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the '
    'hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A '
    'PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this '
    'program. If not, see <https://www.gnu.org/licenses/>.'
)
GNU_NAMES = {"GPL-3.0": "General Public License", "LGPL-3.0": "Lesser General Public License", "AGPL-3.0": "Affero General Public License"}
TEMPLATES |= TEXTS | {f"{key}-notice-text": GNU_NOTICE.format(name=name) for key, name in GNU_NAMES.items()}


def words(text: Column) -> Column:
    """Words of letters a-z and digits, lower-cased; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^a-z0-9]+", -1), lambda w: w != "")


def shingle_hashes(w: Column) -> Column:
    """A hash of each run of five words."""
    at = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))


def shingles(w: Column) -> Column:
    """The different runs of five words as strings."""
    at = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(1), F.size(w) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.slice(w, i, SHINGLE))))


def band_values(hashes: Column) -> Column:
    """MinHash values of the hashes, one for each band."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))))

    return F.array(*[least(k) for k in range(BANDS)])


def _least_hashes(hashes: Column) -> Column:
    """The hashes that the band values are of."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(k)).alias("v"), h.alias("h"))))["h"]

    return F.array(*[least(k) for k in range(BANDS)])


def _prepared(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """License, window length, different shingles, and for each band the template's value and the hash (anchor) that it is of."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", words(F.col("text")).alias("w"))
    rows = rows.select("license", shingles(F.col("w")).alias("shingles"), shingle_hashes(F.col("w")).alias("h"))
    rows = rows.select("license", "shingles", F.size("h").alias("n"), band_values(F.col("h")).alias("values"), _least_hashes(F.col("h")).alias("anchors"))
    found = [{"no": i} | r.asDict() for i, r in enumerate(rows.sort("license").collect())]
    if short := [t["license"] for t in found if not t["n"]]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    if sum(len(t["shingles"]) for t in found) > MAX_SHINGLES:
        raise ValueError(f"templates of more than {MAX_SHINGLES} shingles")
    return found


def _range(first: Column, last: Column, count: int, depth: int) -> Column:
    """The two ends of a range of window starts: where it begins to count, and where no more."""

    def end(at: Column, sign: int) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(sign * count).alias("count"), F.lit(sign * depth).alias("depth"))

    return F.when(first <= last, F.array(end(first, 1), end(last + 1, -1))).otherwise(F.array().cast("array<struct<at:int,count:int,depth:int>>"))


def _collisions() -> Column:
    """The starts of the windows that collide with template ``t`` in any band: a range around each of the band's anchors."""
    n = F.col("t.n")
    final = F.greatest(F.size("h") - n, F.lit(0))

    def around(p: Column, k: Column, value: Column) -> Column:
        def smaller(first: Column, size: Column) -> Column:
            hashes = F.slice(F.col("h"), first + 1, size)
            return F.filter(F.transform(hashes, lambda h, i: F.when(F.xxhash64(h, k) < value, first + i)), lambda q: q.isNotNull())

        left = F.greatest(p - n + 1, F.lit(0))
        before, after = F.array_max(smaller(left, p - left)), F.array_min(smaller(p + 1, n - 1))
        return _range(F.greatest(F.least(left, final), before + 1), F.least(p, final, after - n), 0, 1)

    def band(anchor: Column, k: Column) -> Column:
        at = F.filter("places", lambda x: x["h"] == anchor)
        return F.flatten(F.transform(at, lambda x: around(x["p"], k, F.get(F.col("t.values"), k))))

    return F.flatten(F.transform("t.anchors", band))


def _shares(known: list[dict]) -> Column:
    """For each shingle of template ``t`` in the text from ``first`` on, the starts of the windows in which it comes first."""
    n, final = F.col("t.n"), F.greatest(F.size("h") - F.col("t.n"), F.lit(0))
    keys = [f"{t['no']} {s}" for t in known for s in t["shingles"]]

    def at(i: Column) -> Column:
        text = F.concat_ws(" ", F.slice(F.col("w"), i + 1, SHINGLE))
        return _let(text, lambda s: F.when(F.concat_ws(" ", F.col("t.no").cast("string"), s).isin(keys), F.struct(s.alias("s"), i.alias("p"))))

    def ranges(found: Column) -> Column:
        earlier = F.concat(F.array(F.lit(None).cast("struct<s:string,p:int>")), found)
        both = F.transform(found, lambda x, i: F.struct(x["p"].alias("p"), _let(F.get(earlier, i), lambda y: F.when(x["s"] == y["s"], y["p"])).alias("q")))
        return F.flatten(F.transform(both, lambda x: _range(F.greatest(F.least(F.greatest(x["p"] - n + 1, F.lit(0)), final), x["q"] + 1), F.least(x["p"], final), 1, 0)))

    end = F.least(F.col("last") + n, F.size("h")) - 1
    return _let(F.array_sort(F.filter(F.transform(F.sequence(F.col("first"), end), at), lambda x: x.isNotNull())), ranges)


def _best_start(ends: Column) -> Column:
    """The first of the best starts within colliding windows: the state is looked at before the first end of another place."""
    zero = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("count"), F.lit(0).alias("depth"), F.lit(0).alias("best"), F.lit(-1).alias("start"))

    def step(a: Column, x: Column) -> Column:
        better = (x["at"] > a["at"]) & (a["depth"] > 0) & (a["count"] > a["best"])
        return F.struct(
            x["at"].alias("at"),
            (a["count"] + x["count"]).alias("count"),
            (a["depth"] + x["depth"]).alias("depth"),
            F.when(better, a["count"]).otherwise(a["best"]).alias("best"),
            F.when(better, a["at"]).otherwise(a["start"]).alias("start"),
        )

    return F.aggregate(F.array_sort(ends), zero, step)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment and first_word of every template that a document holds.

    ``containment`` is the largest part of the template's shingles in one window, rounded to
    6 digits, ``first_word`` (from 0) where the first such window starts. Null, empty and
    short texts (under five words) hold none. Rows that repeat an id are
    reported together. Other columns are left out. An empty table or list of templates gives no rows.
    """
    spark = docs.sparkSession
    empty = "doc_id {}, license string, containment double, first_word bigint"
    if not templates and templates is not None:
        return spark.createDataFrame([], empty.format(docs.schema[id_col].dataType.simpleString()))
    known = _prepared(spark, TEMPLATES if templates is None else templates)
    anchors = sorted({a for t in known for a in t["anchors"]})
    # An exploded array of one is worked out once for a row; a plain column would be copied into every lambda that uses it.
    split = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(words(F.col(text_col)))).alias("w"))
    held = split.select("doc_id", "w", F.explode(F.array(shingle_hashes(F.col("w")))).alias("h"))
    held = held.where(F.arrays_overlap("h", F.array(*[F.lit(a) for a in anchors])))
    places = F.filter(F.transform("h", lambda h, i: F.when(h.isin(anchors), F.struct(h.alias("h"), i.alias("p")))), lambda x: x.isNotNull())
    listed = json.dumps([{k: t[k] for k in ("no", "license", "n", "values", "anchors")} | {"size": len(t["shingles"])} for t in known])
    listed = F.from_json(F.lit(listed), "array<struct<no:int,license:string,n:int,size:int,values:array<bigint>,anchors:array<bigint>>>")
    held = held.select("doc_id", "w", "h", F.explode(F.array(places)).alias("places"))
    near = held.select("*", F.explode(F.filter(listed, lambda t: F.arrays_overlap(t["anchors"], F.col("places")["h"]))).alias("t"))
    near = near.select("doc_id", "w", "h", "t", F.explode(F.array(_collisions())).alias("hits")).where(F.size("hits") > 0)
    near = near.select("*", F.array_min(F.col("hits")["at"]).alias("first"), (F.array_max(F.col("hits")["at"]) - 1).alias("last"))
    found = near.select("doc_id", "t.license", "t.size", F.explode(F.array(_best_start(F.concat("hits", _shares(known))))).alias("m"))
    found = found.select("doc_id", "license", F.col("m.start").cast("long").alias("start"), (F.col("m.best") / F.col("size")).alias("part")).where(F.col("part") >= containment - 1e-9)
    best = F.max(F.struct("part", (-F.col("start")).alias("first")))
    return found.groupBy("doc_id", "license").agg(best.alias("best")).select("doc_id", "license", F.round("best.part", 6).alias("containment"), (-F.col("best.first")).alias("first_word"))


def scan_sql(templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> str:
    """The same by trying every window that holds a shingle of a template."""
    listed = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((templates or TEMPLATES).items()))
    cut = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH t0 AS (SELECT license, {cut} AS w FROM (VALUES {listed}) v(license, text)),
t AS (SELECT license, len(w) - {SHINGLE - 1} AS n, unnest(range(1, len(w) - {SHINGLE - 2})) AS i, w FROM t0),
tpl AS (SELECT DISTINCT license, n, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s FROM t),
parts AS (SELECT license, count(*) AS k FROM tpl GROUP BY license),
d0 AS (SELECT doc_id, {cut} AS w FROM documents),
d1 AS (SELECT doc_id, len(w) - {SHINGLE - 1} AS total, unnest(range(1, len(w) - {SHINGLE - 2})) AS i, w FROM d0 WHERE len(w) >= {SHINGLE}),
hits AS (SELECT doc_id, total, i - 1 AS p, license, n, s FROM d1 JOIN tpl ON array_to_string(w[i : i + {SHINGLE - 1}], ' ') = s),
starts AS (SELECT DISTINCT doc_id, license, n, unnest(range(least(greatest(p - n + 1, 0), greatest(total - n, 0)), least(p, greatest(total - n, 0)) + 1)) AS start FROM hits),
found AS (SELECT a.doc_id, a.license, a.start, count(DISTINCT h.s) / any_value(pt.k)::DOUBLE AS part
  FROM starts a JOIN hits h ON a.doc_id = h.doc_id AND a.license = h.license AND h.p BETWEEN a.start AND a.start + a.n - 1 JOIN parts pt ON a.license = pt.license GROUP BY ALL),
best AS (SELECT doc_id, license, max(part) AS part FROM found WHERE part >= {containment} - 1e-9 GROUP BY ALL)
SELECT doc_id, license, round(part, 6) AS containment, min(start) AS first_word FROM best JOIN found USING (doc_id, license, part) GROUP BY ALL
"""
