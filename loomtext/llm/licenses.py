"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Everything is built from DataFrame functions. Words are runs of letters and digits, so that punctuation around a notice
does not hide it; shingles are five words. A template of m shingles belongs to the size
class c, the least power of two from m up; texts are cut into windows of c + max(1, c / 2) shingles that begin every
max(1, c / 2), so a passage of up to c shingles lies whole in one. Such a window has a Jaccard similarity of a quarter
or more with a template of which it contains four fifths, and with BANDS bands of one row it collides with it with a
probability of 1 - (3 / 4) ** BANDS or more, which is 0.9999. Candidates are verified exactly by the share of the
template's shingles that the window contains. Only windows that share a shingle with a template of their class are hashed,
and none of a class of which the text has fewer shingles than its shortest template needs.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.shared import own_id

SHINGLE = 5
BANDS = 32
#: Public license notices and texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
)


def words(text: str) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingled(rows: DataFrame) -> DataFrame:
    """Adds shingles, hashes of five words, in order: of fewer words the one whole sequence, of none null."""
    wide = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, SHINGLE)))
    return rows.withColumn("words", words("text")).withColumn("shingles", F.when(F.size("words") > 0, wide)).drop("words")


def minhashes(shingles: str) -> Column:
    """BANDS MinHash values of an array of random hashes: the least after exclusive or with each of as many constants."""
    dice = random.Random(1729)
    seeds = F.array(*[F.lit(dice.getrandbits(64) - (1 << 63)) for _ in range(BANDS)])
    return F.transform(seeds, lambda s: F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(s))))


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """template, license, shingles (distinct), class: one row a template that has words."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)])
    held = shingled(spark.range(1, numPartitions=1).select(F.explode(rows).alias("x")).select("x.*")).where("shingles is not null").withColumn("shingles", F.array_distinct("shingles"))
    return held.withColumn("class", F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles")))).cast("int")).drop("text")


def _spots(size: int, known: list[int], least_hits: int) -> Column:
    """The windows of a size class that cover a hit, as structs of class, start (from 1) and length.

    A hit is a place with a shingle of the class's templates (known); with fewer hits than any of them needs there is none.
    """
    step = max(1, size // 2)
    length = size + step
    own = F.array_intersect("common", F.array(*map(F.lit, known)))
    places = F.when(F.size(own) >= least_hits, F.filter("hits", lambda h: F.array_contains(own, F.get("shingles", h - 1)))).otherwise(F.array().cast("array<int>"))
    numbers = F.array_distinct(F.flatten(F.transform(places, lambda h: F.sequence(F.greatest(F.lit(0), F.floor((h - length + step - 1) / step).cast("int")), F.floor((h - 1) / step).cast("int")))))
    return F.transform(numbers, lambda j: F.struct(F.lit(size).alias("class"), (j * step + 1).alias("start"), F.lit(length).alias("length")))


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, template, license, containment, start_word: each template found in a document, with its best window.

    The templates are a parameter of the call and small, so they are broadcast. Ties go to the first window. A null or
    empty text, and no templates, give no rows; repeated documents each give theirs; other columns
    are not looked at.
    """
    none = own_id(docs).where("false").select("doc_id", F.lit(0).alias("template"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("start_word"))
    if not templates:
        return none
    known = template_table(docs.sparkSession, templates)
    found = known.select("template", "class", F.explode("shingles").alias("s")).collect()
    if not found:
        return none
    any_of = F.array(*[F.lit(s) for s in sorted({r["s"] for r in found})])
    # The row number keeps Spark from evaluating the shingles again inside the filter.
    texts = shingled(own_id(docs)).select("doc_id", "shingles", F.monotonically_increasing_id().alias("row")).where(F.arrays_overlap("shingles", any_of))
    common = texts.withColumn("common", F.array_intersect("shingles", any_of))
    held = common.withColumn("hits", F.filter(F.sequence(F.lit(1), F.size("shingles")), lambda i: F.array_contains("common", F.get("shingles", i - 1))))
    parts: dict[int, dict[int, set[int]]] = {}
    for r in found:
        parts.setdefault(r["class"], {}).setdefault(r["template"], set()).add(r["s"])
    spots = F.flatten(F.array(*[_spots(c, sorted(set().union(*own.values())), min(math.ceil(least * len(x) - 1e-9) for x in own.values())) for c, own in sorted(parts.items())]))
    windows = held.select("row", "doc_id", "shingles", F.explode(spots).alias("at")).select("row", "doc_id", "at.class", "at.start", F.slice("shingles", F.col("at.start"), F.col("at.length")).alias("window"))
    hashed = windows.withColumn("bands", minhashes("window")).select("row", "doc_id", "class", "start", "window", F.posexplode("bands").alias("band", "value"))
    index = known.withColumn("bands", minhashes("shingles")).select("template", "class", F.posexplode("bands").alias("band", "value"))
    hits = hashed.join(F.broadcast(index), ["class", "band", "value"]).groupBy("row", "doc_id", "class", "start", "template").agg(F.first("window").alias("window"))
    share = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    sure = hits.join(F.broadcast(known.select("template", "license", "shingles")), "template").withColumn("containment", share).where(F.col("containment") >= least)
    best = sure.groupBy("row", "doc_id", "template", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("at"))).alias("x"))
    return best.select("doc_id", "template", "license", "x.containment", (-F.col("x.at") - 1).alias("start_word"))
