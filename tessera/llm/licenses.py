"""License scan by diagonal voting.

Hashes of all runs of `k` words of every document are joined to the places that
they have in license templates. Hits of one document and template vote for
their diagonal, the place in the document less that in the template: a verbatim
copy has all its hits on one, an edited one on a few close to each other.
Neighbouring diagonals are merged, and a merged span is verified by the share
of the template's words that its hits cover, and by its length. Copies that
follow each other closely are merged too; they are parted where the template
starts over, and if two or more of the parts are licenses, or the whole isn't,
the parts that are count instead. Templates resemble each other, so of spans of
different licenses that overlap, one is left out if another has a higher score,
or covers more words with an equal one, or comes first by name with both equal.

Defined results. A row for each verified span, in words from 0, end exclusive.
Rows equal in doc_id and text are one document. Null and empty texts have no
spans. Words are compared in lower case. A template found several times in a
document gives a row for each copy. Templates with fewer than k words are never found. Whole texts are read,
however long. Other columns are passed over. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.cluster import doc_key, small_batches, with_small_side
from tessera.llm.textcore import Words, chunks, signed

K = 3
#: Diagonals at most so far apart are of one copy.
SLACK = 6
#: Least share of the template's words that is covered.
LEAST = 0.7
#: Longest span, as a multiple of the template's words.
LONGEST = 2.0

#: Statements and notices as they are commonly written; name and text.
TEMPLATES = {
    "MIT statement": "Released under the MIT License.",
    "MIT short": "Licensed under the MIT License.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0 statement": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
}


def template_grams(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """(license, n_template, at, hash) of every run of k words."""
    names = sorted(templates)
    words = Words(pa.array([templates[n] for n in names], pa.string()))
    hashes, owner, where = words.grams(k)
    count = words.counts()
    rows = [(names[o], int(count[o]), int(w - words.doc[o]), int(h)) for h, o, w in zip(signed(hashes), owner, where, strict=True)]
    return spark.createDataFrame(rows, "license string, n_template int, at int, hash long")


def _rolling(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            words = Words(b.column("text"))
            hashes, owner, where = words.grams(k)
            ids, keys = b.column("doc_id"), b.column("key")
            for a in range(0, len(where), 1 << 16):
                s = slice(a, a + (1 << 16))
                at = pa.array(owner[s])
                yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), pa.array((where[s] - words.doc[owner[s]]).astype(np.int32)), pa.array(signed(hashes[s]))], ["doc_id", "key", "place", "hash"])

    return run


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K, slack: int = SLACK, least: float = LEAST, longest: float = LONGEST) -> DataFrame:
    """(doc_id, license, start_word, end_word, covered, score) of every span that is a license."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", doc_key())
    rolling = keyed.mapInArrow(_rolling(k), "doc_id long, key long, place int, hash long")
    hits = rolling.join(with_small_side(template_grams(spark, templates, k)), "hash")
    of = ["doc_id", "key", "license", "n_template"]
    votes = hits.groupBy(*of, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"))
    along = Window.partitionBy("key", "license").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= slack, 0).otherwise(1)
    merged = votes.withColumn("fresh", fresh).withColumn("copy", F.sum("fresh").over(along))
    placed = merged.select(*of, "copy", "diagonal", F.explode("at").alias("at")).withColumn("place", F.col("diagonal") + F.col("at"))
    # in copies one after the other the template starts over
    on = Window.partitionBy("key", "license", "copy").orderBy("place", "at")
    again = placed.withColumn("again", F.when(F.col("at") <= F.lag("at").over(on), 1).otherwise(0)).withColumn("part", F.sum("again").over(on))
    span = F.struct("a", (F.col("z") + k).alias("end_word"), F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x, x + k - 1))))).alias("covered"))

    def good(x):
        return (x["covered"] / F.col("n_template") >= least) & (x["end_word"] - x["a"] <= F.col("n_template") * F.lit(longest))

    parts = again.groupBy(*of, "copy", "part").agg(F.min("place").alias("a"), F.max("place").alias("z"), F.collect_set("at").alias("at")).withColumn("span", span)
    parts = parts.groupBy(*of, "copy").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.collect_list("span").alias("parts"))
    parts = parts.withColumn("parts", F.filter("parts", good)).withColumn("span", span)
    rows = parts.withColumn("span", F.explode(F.when((F.size("parts") < 2) & good(F.col("span")), F.array("span")).otherwise(F.col("parts"))))
    found = rows.select("doc_id", "key", "license", F.col("span.a").alias("start_word"), "span.end_word", "span.covered", (F.col("span.covered") / F.col("n_template")).alias("score"))
    return _best(found).select("doc_id", "license", "start_word", "end_word", "covered", "score")


def _best(found: DataFrame) -> DataFrame:
    """Spans without those that a better one of another license overlaps. Overlapping spans of a document lie side by side, so only they are compared."""
    by = Window.partitionBy("key").orderBy("start_word", "end_word", "license")
    ended = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_word") < ended, 0).otherwise(1)).over(by)
    grouped = found.withColumn("island", island).groupBy("key", "island").agg(F.collect_list(F.struct("doc_id", "license", "start_word", "end_word", "covered", "score")).alias("spans"))

    def beats(y, x):
        better = (y["score"] > x["score"]) | (y["score"] == x["score"]) & ((y["covered"] > x["covered"]) | (y["covered"] == x["covered"]) & (y["license"] < x["license"]))
        return (y["license"] != x["license"]) & (y["start_word"] < x["end_word"]) & (x["start_word"] < y["end_word"]) & better

    spans = F.col("spans")
    return grouped.select(F.explode(F.filter(spans, lambda x: ~F.exists(spans, lambda y: beats(y, x)))).alias("s")).select("s.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(templates: dict[str, str] = TEMPLATES, k: int = K, slack: int = SLACK, least: float = LEAST, longest: float = LONGEST) -> str:
    words = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"
    values = ", ".join("('{}', '{}')".format(n.replace("'", "''"), t.replace("'", "''")) for n, t in sorted(templates.items()))
    return f"""
WITH t AS (SELECT license, {words} AS w FROM (VALUES {values}) v(license, text)),
tg AS (SELECT license, len(w) AS n_template, i - 1 AS spot, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {k} + 2)) AS i FROM t)),
d AS (SELECT DISTINCT doc_id, text, {words} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, text, i - 1 AS place, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {k} + 2, 1))) AS i FROM d)),
hits AS (SELECT doc_id, text, license, n_template, place, spot, place - spot AS diagonal FROM dg JOIN tg USING (g)),
diagonals AS (SELECT DISTINCT doc_id, text, license, diagonal FROM hits),
fresh AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, text, license ORDER BY diagonal) <= {slack} THEN 0 ELSE 1 END AS f FROM diagonals),
copies AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, text, license ORDER BY diagonal) AS copy FROM fresh),
placed AS (SELECT h.*, c.copy FROM hits h JOIN copies c USING (doc_id, text, license, diagonal)),
again AS (SELECT *, CASE WHEN spot <= lag(spot) OVER (PARTITION BY doc_id, text, license, copy ORDER BY place, spot) THEN 1 ELSE 0 END AS again FROM placed),
parted AS (SELECT *, sum(again) OVER (PARTITION BY doc_id, text, license, copy ORDER BY place, spot ROWS UNBOUNDED PRECEDING) AS part FROM again),
both_ways AS (SELECT doc_id, text, license, n_template, copy, part, place, spot FROM parted UNION ALL SELECT doc_id, text, license, n_template, copy, -1, place, spot FROM parted),
cover AS (SELECT doc_id, text, license, copy, part, count(DISTINCT word) AS covered FROM (SELECT *, unnest(range(spot, spot + {k})) AS word FROM both_ways) GROUP BY ALL),
spans AS (SELECT doc_id, text, license, copy, part, any_value(n_template) AS n_template, min(place) AS start_word, max(place) + {k} AS end_word FROM both_ways GROUP BY ALL),
good AS (SELECT *, covered / n_template::DOUBLE AS score FROM spans JOIN cover USING (doc_id, text, license, copy, part)
  WHERE covered / n_template::DOUBLE >= {least} AND end_word - start_word <= n_template * {longest}::DOUBLE),
counted AS (SELECT *, count(*) FILTER (part >= 0) OVER w AS n_parts, count(*) FILTER (part < 0) OVER w AS n_whole FROM good WINDOW w AS (PARTITION BY doc_id, text, license, copy)),
chosen AS (SELECT * FROM counted WHERE CASE WHEN n_parts < 2 AND n_whole = 1 THEN part < 0 ELSE part >= 0 END)
SELECT doc_id, license, start_word::INT AS start_word, end_word::INT AS end_word, covered::INT AS covered, score
FROM chosen x
WHERE NOT EXISTS (SELECT 1 FROM chosen y WHERE y.doc_id IS NOT DISTINCT FROM x.doc_id AND y.text = x.text AND y.license <> x.license
  AND y.start_word < x.end_word AND x.start_word < y.end_word
  AND (y.score > x.score OR y.score = x.score AND (y.covered > x.covered OR y.covered = x.covered AND y.license < x.license)))
"""


ORACLE = oracle()
