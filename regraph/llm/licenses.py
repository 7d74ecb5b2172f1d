"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

1. Headers: the sentences and lines of a text that hold a licence cue, both as they stand and with
   hard-wrapped lines joined (a line that goes on in lower case, behind a comment's leading marks). A
   text named like a licence file is, with all its white space as one space, also a header as a
   whole; if that reaches a template, it decides. Distinct headers are scored once, however many
   documents share them.
2. Terms weigh tf * (ln((1 + N) / (1 + df)) + 1) with df counted over all distinct headers and
   templates. The cosine to a template is a join on terms (templates are a small fixed table) and a
   sum; a header's licence is the template with the largest cosine of at least `least`, ties to the
   smaller name.
3. A licence file is named like one, or is a text that as a whole is a header of a template. Each
   directory takes the licence of its files of that kind (largest score, then smallest path).
4. A document without a licence of its own takes that of its nearest ancestor directory: its
   ancestors are joined to the directories by path, and the deepest match wins.

Nulls, ties, odd input: null and empty texts have no licence of their own but inherit; a null path
inherits nothing; very long texts are scanned whole; repeated rows each get a row; an empty table gives no rows; input columns that
have the names of the output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table, text_or_empty, written

#: Public licence texts (fixed values).
GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
MIT_TEXT = (
    "MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_START = (
    "Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES, HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Template statements (fixed values); several may stand for one licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under this license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Public-Domain", "This work is dedicated to the public domain under the CC0 license"),
    ("GPL-3.0", GPL_NOTICE.format(3)),
    ("GPL-2.0", GPL_NOTICE.format(2)),
    ("MIT", MIT_TEXT),
    ("BSD-3-Clause", f"{BSD_START} {BSD_NAMES} {BSD_END}"),
    ("BSD-2-Clause", f"{BSD_START} {BSD_END}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("All-Rights-Reserved", "Copyright. All rights reserved"),
    ("All-Rights-Reserved", "All rights reserved"),
]
CUE = r"(?i)licen[sc]e|licensing|copyright|rights reserved|public domain|creative commons|redistribution and use|permission is hereby granted"
#: A line break in the middle of a sentence, with the comment marks before its next line.
WRAP = r"(?<![.!?:\x20\x09\x0A\x0D])[\x20\x09]*\x0D?\x0A[\x20\x09]*(?:[#*;%]+|//+|--+|\|)?[\x20\x09]*(?=[a-z(])"
BREAK = r"(?<=[.!?])[\x20\x09-\x0D]+|[\x0A\x0D]+"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
LEAST = 0.6


def terms_of(header: Column) -> Column:
    return F.regexp_extract_all(F.lower(header), F.lit(TERM), F.lit(0))


def scored_headers(headers: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """(header, license, score) of the distinct headers(header) that reach `least` with a template."""
    spark = headers.sparkSession
    given = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, license string, header string")
    counted = lambda df, key: df.select(*key, F.explode(terms_of(F.col("header"))).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    unit = written(counted(headers.distinct(), ["header"]))
    mine = counted(given, ["t", "license"])
    n = headers.distinct().count() + len(templates)
    df = unit.select("term").unionAll(mine.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = written(df.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))
    # a header's length needs all its terms, the product only those of templates
    weighed = unit.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("header").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    vectors = mine.join(idf, "term").withColumn("v", F.col("tf") * F.col("idf"))
    vectors = vectors.join(vectors.groupBy("t").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("_n")), "t").select("t", "license", "term", (F.col("v") / F.col("_n")).alias("v"))
    products = weighed.join(F.broadcast(vectors), "term").groupBy("header", "t", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))  # the fixed templates
    cosine = products.join(norms, "header").select("header", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    return cosine.groupBy("header").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("_b")).select("header", F.col("_b.license").alias("license"), (-F.col("_b.s")).alias("score"))


def scan(docs: DataFrame, path: Column, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, path, license, score, origin (header, inherited or null), license_path."""
    rows = docs.select(F.col("doc_id"), path.alias("path"), text_or_empty().alias("text"))
    cued = lambda text: F.filter(F.split(text, BREAK), lambda s: s.rlike(CUE))
    rows = rows.withColumn("headers", F.when(F.col("text").rlike(CUE), cued(F.col("text"))))
    whole = F.col("text").rlike(CUE) & (F.size("headers") >= 1) & (F.size(F.split(F.trim("text"), BREAK)) == F.size("headers"))
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    piece = lambda rank: lambda h: F.struct(F.lit(rank).alias("rank"), h.alias("header"))
    pieces = F.transform(F.array_union("headers", cued(F.regexp_replace("text", WRAP, " "))), piece(1))
    text = F.when(named, F.array(piece(0)(F.trim(F.regexp_replace("text", SPACES, " "))))).otherwise(F.slice(F.array(piece(0)(F.lit(""))), 1, 0))
    own = rows.where(F.size("headers") > 0).select("doc_id", "path", (whole | named).alias("is_file"), F.explode(F.concat(text, pieces)).alias("_p")).select("doc_id", "path", "is_file", "_p.*")
    own = written(own)
    scores = written(scored_headers(own.select("header"), least, templates))
    best = own.join(scores, "header").groupBy("doc_id", "path").agg(F.min(F.struct("rank", (-F.col("score")).alias("s"), "license")).alias("_b"), F.max("is_file").alias("is_file"))
    best = written(best.select("doc_id", "path", F.col("_b.license").alias("license"), (-F.col("_b.s")).alias("score"), "is_file"))
    directory = F.regexp_replace("path", "[^/]*$", "")
    homes = best.where("is_file and path is not null").groupBy(directory.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"), "license")).alias("_h"))
    homes = written(homes.select("dir", F.col("_h.license").alias("_license"), (-F.col("_h.s")).alias("_score"), F.col("_h.p").alias("_from")))
    # each directory, not each document, looks its ancestors up
    dirs = rows.where("path is not null").select(directory.alias("of")).distinct()
    parts = F.split("of", "/")
    up = dirs.withColumn("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))))
    near = up.join(homes, "dir").groupBy("of").agg(F.max(F.struct(F.length("dir").alias("n"), "_license", "_score", "_from")).alias("_i"))
    near = written(near.select("of", F.col("_i._license").alias("_license"), F.col("_i._score").alias("_score"), F.col("_i._from").alias("_from")))
    base = rows.select("doc_id", "path", directory.alias("_of"))
    mine = best.select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), "license", "score")
    out = base.join(mine, base["doc_id"].eqNullSafe(F.col("_id")) & base["path"].eqNullSafe(F.col("_path")), "left").drop("_id", "_path")
    out = out.join(near, F.col("_of") == F.col("of"), "left")
    has = F.col("license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "_license").alias("license"),
        F.when(has, F.col("score")).otherwise(F.col("_score")).alias("score"),
        F.when(has, F.lit("header")).when(F.col("_license").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("_from")).alias("license_path"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files source/lang/doc_id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return scan(table(spark, sf_dir, "documents"), path)
