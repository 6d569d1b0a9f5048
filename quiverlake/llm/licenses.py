"""License scans: TF-IDF cosine of headers and license files to templates, then inheritance along paths.

Of a text that has one of the anchor words, passages are: each line, cut after
each ". ", that has one; each paragraph of several lines that has one, so that a
wrapped header is one passage; and the whole text, as a license file is. A
passage's words are weighed by tf * idf, with idf from all passages of the
corpus, and compared with each template (notices, headers, whole licenses) by
sparse cosine: a join of words with the words of the templates, which are a
fixed small table. A file has the license of its best passage from ``least`` on
(ties: the longer template, then the first name); the notice that all rights are
reserved (``LAST``), which whole licenses have too, counts only where no other one does. A file named as a
license file also licenses its directory; a file without a license of its own
takes that of the nearest ancestor directory that has one, found by joining the
ancestors of distinct directories with the licensed directories.

Words that many passages have, the number of which is bounded by ``COMMON``, are
looked up in a broadcast table, the others joined by key. DataFrame functions
only. Rows: null and empty texts have no passage. Rows with one id and path are
one file; rows with null id or path have no license and inherit none. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverlake.llm._common import cut_lineage

# Parts that several whole licenses share.
_AS_IS_MIT = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_AS_IS_ISC = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_AS_IS_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
# Notices by which licenses are commonly declared.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Licensed under the ISC License."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "All rights reserved."),
    # Headers and openings of whole licenses, by which their files begin.
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    # Whole licenses.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS_MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS_ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS_ISC),
    ("BSD-2-Clause", _BSD_2 + _AS_IS_BSD),
    ("BSD-3-Clause", _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS_BSD),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
#: Counts only where no other license does. Words that more than one in ``COMMON`` passages have are common.
LAST, COMMON = "Proprietary", 2000
ANCHORS = "licen[sc]e|copyright|permission|redistribution|rights reserved|public domain|free software"
LICENSE_FILES = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
WORDS = "[a-z0-9]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _counts(words: Column) -> Column:
    """(word, tf) of each distinct word, by runs of the sorted words."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def runs(s: Column) -> Column:
        n = F.size(s)
        heads = F.filter(F.sequence(F.lit(1), n), lambda p: (p == 1) | (F.get(s, p - 1) != F.get(s, p - 2)))
        one = lambda heads: F.transform(heads, lambda at, k: F.struct(F.get(s, at - 1).alias("word"), (F.coalesce(F.get(heads, k + 1), n + 1) - at).alias("tf")))
        return F.when(n == 0, F.array().cast("array<struct<word:string,tf:int>>")).otherwise(let(heads, one))

    return let(F.sort_array(words), runs)


def file_licenses(files: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, path, license, score) of the files (id, path, text) with a license of their own."""
    spark = files.sparkSession
    has = F.lower("text").rlike(ANCHORS) & F.col("id").isNotNull() & F.col("path").isNotNull()
    anchored = lambda c: F.lower(c).rlike(ANCHORS)
    lines = F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n")
    paragraphs = F.filter(F.split("text", "\n\n"), lambda p: F.contains(p, F.lit("\n")))
    numbered = lambda texts, kind: F.transform(texts, lambda t, k: F.struct(F.lit(kind).alias("kind"), k.alias("pos"), t.alias("line")))
    kinds = F.array(*[numbered(texts, kind) for kind, texts in enumerate((lines, paragraphs, F.array("text")))])
    once = files.filter(has).select("id", "path", "text").dropDuplicates(["id", "path", "text"])
    each = once.select("id", "path", F.explode(F.filter(F.flatten(kinds), lambda p: anchored(p["line"]))).alias("p"))
    # A passage goes by a number, as long as the table that gives it is stored; its words are counted in its own row.
    passages = cut_lineage(each.select(F.monotonically_increasing_id().alias("num"), "id", "path", _counts(_words(F.col("p.line"))).alias("counts")))
    counted = passages.select("num", F.explode("counts").alias("c")).select("num", "c.word", "c.tf")
    n = passages.count()
    frequency = cut_lineage(counted.groupBy("word").agg(F.count("*").alias("df")))
    idf = lambda df: F.log(F.lit(1.0 + n) / (1.0 + F.coalesce(df, F.lit(0)))) + 1.0
    table = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(TEMPLATES)], "template int, license string, notice string")
    terms = table.select("template", "license", F.explode(_words(F.col("notice"))).alias("word")).groupBy("template", "license", "word").agg(F.count("*").alias("t_tf"))
    terms = terms.join(frequency, "word", "left").select("template", "license", "word", (F.col("t_tf") * idf(F.col("df"))).alias("t_w"), "t_tf")
    norms = terms.groupBy("template").agg(F.sqrt(F.sum(F.col("t_w") * F.col("t_w"))).alias("t_norm"), F.sum("t_tf").alias("t_words"))
    terms = cut_lineage(terms.join(norms, "template").select("word", "template", "license", "t_words", (F.col("t_w") / F.col("t_norm")).alias("t_w")))
    often = F.col("df") > n // COMMON
    met = counted.join(F.broadcast(frequency.where(often).withColumnRenamed("df", "df_often")), "word", "left")
    seldom = met.where("df_often is null").drop("df_often").join(frequency.where(~often), "word")
    weighed = met.where("df_often is not null").withColumnRenamed("df_often", "df").unionByName(seldom).withColumn("w", F.col("tf") * idf(F.col("df")))
    size = weighed.groupBy("num").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(terms), "word").groupBy("num", "template").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    near = dots.join(size, "num").select("num", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= least)
    names = F.broadcast(terms.select("template", "license", "t_words").distinct())
    scored = near.join(names, "template").join(passages.select("num", "id", "path"), "num")
    best = scored.groupBy("id", "path", "license", "t_words").agg(F.max("score").alias("score"))
    first = Window.partitionBy("id", "path").orderBy(F.col("license") == LAST, F.desc("score"), F.desc("t_words"), "license")
    return best.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "t_words")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(df: DataFrame, id_col: str, path: Column, text_col: str = "text", least: float = 0.6) -> DataFrame:
    """(id, path, own_license, own_score, license, license_from) for each row.

    ``license_from``: the folder whose license the file inherits, null if it is the file's own.
    """
    files = df.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text"))
    own = cut_lineage(file_licenses(files, least))
    rows = files.select("id", "path", _folder(F.col("path")).alias("folder"))
    licensed = own.filter(F.col("path").rlike(LICENSE_FILES)).groupBy(_folder(F.col("path")).alias("above")).agg(F.max_by(F.col("license"), F.struct(F.col("score"), F.col("license"))).alias("above_license"))
    parts = F.split("folder", "/")
    folders = rows.filter("folder is not null").select("folder").distinct()
    up = folders.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = up.join(licensed, "above").groupBy("folder").agg(F.max_by(F.struct("above", "above_license"), "depth").alias("n")).select("folder", "n.above", "n.above_license")
    found = rows.join(own, ["id", "path"], "left").join(nearest, "folder", "left")
    return found.select(
        F.col("id").alias(id_col), "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"),
        F.coalesce("license", "above_license").alias("license"), F.when(F.col("license").isNull(), F.col("above")).alias("license_from"),
    )
