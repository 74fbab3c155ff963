"""License notices and texts by Dice coefficient over word bigrams, in DataFrame operations only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str, end: str) -> str:
    """The notice that the GNU licenses ask for, at a program's head."""
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. {end}"


_SEE = "If not, see <https://www.gnu.org/licenses/>."
_WRITE = "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."

#: One-line notices, the headers that licenses ask for, and the short licenses' whole texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}'),
    ("MIT-0", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. {_AS_IS}'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_NAME} {_BSD_END}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("GPL-2.0-or-later", _gnu("General Public License", "2", _WRITE)),
    ("GPL-3.0-or-later", _gnu("General Public License", "3", _SEE)),
    ("LGPL-2.1-or-later", _gnu("Lesser General Public License", "2.1", _WRITE)),
    ("LGPL-3.0-or-later", _gnu("Lesser General Public License", "3", _SEE)),
    ("AGPL-3.0-or-later", _gnu("Affero General Public License", "3", _SEE)),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
DICE = 0.8
#: Bigrams of a document that start in one piece; no row holds a longer piece than this and the longest template.
STEP = 512
_WORDS = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _WORDS), "")


def _bigrams(words: str) -> Column:
    """Hashes of a word array's bigrams, in order; empty below two words."""
    w = F.col(words)
    return F.when(F.size(w) < 2, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``template, license_id, length, grams``: words of each template and its distinct bigrams."""
    raw = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, license_id string, text string")
    words = raw.select("template", "license_id", _words(F.col("text")).alias("words"))
    return words.select("template", "license_id", F.size("words").alias("length"), F.array_distinct(_bigrams("words")).alias("grams")).where("length > 1")


def least_shared(grams: int, dice: float) -> int:
    """Bigrams that a window must share with a template of so many, whatever the window's size.

    2 s / (a + b) can reach d only for a size a between b d / (2 - d) and b (2 - d) / d; as
    s is at most a, s itself must be b d / (2 - d) at least.
    """
    return ceil(grams * dice / (2 - dice) - 1e-9)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    """``doc_id, license_id, dice, n_places``: the licenses whose notice or text a document holds.

    Text is lower-cased and reduced to words of letters and digits, over line breaks. A window
    of a template is as many words as the template has (fewer at the text's end), beginning
    with two that follow each other in the template; its set of bigrams is compared with the
    template's. ``dice`` is the best of all windows, ``n_places`` counts windows of at least
    ``dice``, those less than half a template after another one not again. Only
    templates that a piece of a document shares enough bigrams with (by their size) are
    compared there; documents are never shuffled.

    Null and empty texts, and those below two words, hold nothing; a null doc_id is a
    group; repeated rows, and templates of one license, add up in n_places; empty input
    gives an empty result; other columns are not read.
    """
    known = [r for r in template_table(docs.sparkSession, templates).collect()]  # fixed values
    words = docs.select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("words"))
    grams = words.select("doc_id", _bigrams("words").alias("all"))
    longest = max((r["length"] for r in known), default=2)
    cut = grams.select("doc_id", "all", F.explode(F.expr(f"sequence(0, size(all), {STEP})")).alias("first")).where("first < size(all)")
    base = F.greatest(F.lit(0), F.col("first") - longest)
    pieces = cut.select("doc_id", "first", base.alias("base"), F.slice("all", base + 1, F.lit(STEP + 2 * longest)).alias("piece"))
    every = sorted({g for r in known for g in r["grams"]})
    need = {r["template"]: least_shared(len(r["grams"]), dice) for r in known}
    held = pieces.withColumn("held", F.array_distinct(F.filter("piece", lambda x: x.isin(every)))).where(F.size("held") >= min(need.values(), default=1))
    shares = [F.when(F.size(F.array_intersect("held", F.lit(r["grams"]))) >= need[r["template"]], F.lit(r["template"])) for r in known]
    chosen = held.select("doc_id", "first", "base", "piece", F.explode(F.array_compact(F.array(*shares) if shares else F.array(F.lit(None).cast("int")))).alias("template"))
    both = chosen.join(F.broadcast(template_table(docs.sparkSession, templates)), "template")

    def compared(s: Column) -> Column:
        window = F.array_distinct(F.slice("piece", s + 1, F.col("length") - 1))
        return F.struct(s.alias("s"), (2.0 * F.size(F.array_intersect(window, "grams")) / (F.size(window) + F.size("grams"))).alias("d"))

    starts = F.filter(F.sequence(F.lit(0), F.least(F.size("piece"), F.col("first") - F.col("base") + STEP) - 1), lambda s: F.array_contains("grams", F.get("piece", s)))
    hits = both.select("doc_id", "license_id", "length", (F.col("first") - F.col("base")).alias("own"), F.filter(F.transform(starts, compared), lambda h: h["d"] >= dice).alias("hits")).where("size(hits) > 0")
    mine = hits.select("doc_id", "license_id", "length", "hits", F.filter("hits", lambda h: h["s"] >= F.col("own")).alias("mine")).where("size(mine) > 0")
    new = F.filter("mine", lambda h: ~F.exists("hits", lambda o: (o["s"] < h["s"]) & (2 * (h["s"] - o["s"]) < F.col("length"))))
    found = mine.select("doc_id", "license_id", F.array_max(F.transform("mine", lambda h: h["d"])).alias("d"), F.size(new).alias("n"))
    return found.groupBy("doc_id", "license_id").agg(F.max("d").alias("dice"), F.sum("n").alias("n_places"))


def oracle_sql(templates=TEMPLATES, dice: float = DICE) -> str:
    """The same result in DuckDB's SQL: every window of every document, without pieces or pruning."""
    rows = ", ".join(f"({i}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')" for i, (a, b) in enumerate(templates))
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t AS (SELECT i AS k, license_id, len(w) AS length, list_distinct({grams}) AS g FROM (SELECT i, license_id, {words.format('text')} AS w FROM (VALUES {rows}) AS v(i, license_id, text))),
d AS (SELECT r, doc_id, {grams} AS a FROM (SELECT row_number() OVER () AS r, doc_id, {words.format('text')} AS w FROM documents WHERE text IS NOT NULL)),
p AS (SELECT r, unnest(a) AS b, generate_subscripts(a, 1) AS s FROM d), q AS (SELECT k, unnest(g) AS b FROM t),
w AS (SELECT r, k, s, license_id, doc_id, length, g, list_distinct(a[s : s + length - 2]) AS f FROM p JOIN q USING (b) JOIN t USING (k) JOIN d USING (r)),
h AS (SELECT r, k, s, license_id, doc_id, length, CAST(2.0 AS DOUBLE) * len(list_intersect(f, g)) / (len(f) + len(g)) AS d FROM w),
x AS (SELECT *, s - lag(s) OVER (PARTITION BY r, k ORDER BY s) AS gap FROM h WHERE d >= {dice})
SELECT doc_id, license_id, max(d) AS dice, CAST(sum(CASE WHEN gap IS NULL OR 2 * gap >= length THEN 1 ELSE 0 END) AS BIGINT) AS n_places FROM x GROUP BY doc_id, license_id"""
