"""Operator 8: licence scans by sparse TF-IDF and directory inheritance (native).

Every line of a whole text is looked at. One of which half of the distinct terms are
terms of the templates is a header line; function words are no terms. Compared with the templates are each header
line, each run of adjacent header lines as one text (a header that is wrapped over
lines), and the whole text of a licence file: a file whose name says so, or of which at
least half of the lines are header lines. Distinct texts of these become sparse TF-IDF
vectors, with document frequencies over all of the corpus, and are compared by cosine; a
file's own licence is that of its best one, but of a licence file that of the whole text
if that is like a template. A licence file licenses its directory. Other
files without a licence of their own inherit from the nearest ancestor directory that
has one: each directory is joined with its path prefixes once, and files with their
directory.

Defined results: null texts have no headers; a null path is the root's file '';
repeated rows are judged each and alike; equal scores go to the template id that
comes first, equal licence files to the smaller path. Identical headers, however
many files share them, are scored once. Only the keys, the path and the text are read,
so other columns of any name do not matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Stage, documents

#: Template id -> texts of headers and of whole licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software under the terms of the GNU General Public License, version 3, without any warranty.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": ("This file is subject to the terms of the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorised copying is prohibited."),
}
TERM = r"([a-z0-9]+(?:[.+-][a-z0-9]+)*)"
#: The least cosine; the share of template terms in a header line, of header lines in a
#: licence file.
LEAST, HEADER_SHARE, FILE_SHARE = 0.6, 0.5, 0.5
#: Words that say nothing of a licence.
STOP = ("a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "if", "in", "is", "it", "its", "no", "not", "of", "on", "or", "that", "the", "this", "to", "was", "will", "with", "you", "your")
#: All terms of the templates: a few hundred.
VOCABULARY = sorted({t for texts in TEMPLATES.values() for text in texts for t in re.findall(TERM, text.lower())} - set(STOP))
#: Which of a file's texts decide first.
WHOLE, PART = 0, 1
FILE_NAME = r"(?:^|/)(?:[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]|[Cc][Oo][Pp][Yy][Ii][Nn][Gg])[^/]*$"


def _found(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))


def _terms(text: Column) -> Column:
    return F.filter(_found(text), lambda x: ~x.isin(*STOP))


def _is_header(line: Column) -> Column:
    known = F.array(*map(F.lit, VOCABULARY))
    own = lambda terms: (F.size(terms) > 0) & (F.size(F.array_intersect(terms, known)) >= HEADER_SHARE * F.size(terms))
    return F.transform(F.array(F.array_except(_found(line), F.array(*map(F.lit, STOP)))), own)[0]


def headers(files: DataFrame) -> DataFrame:
    """row_id, the key columns, n_headers, is_file and the texts to compare of (…, path, text)."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    found = files.withColumn("_lines", lines).withColumn("_flags", F.transform("_lines", _is_header))
    heads = F.transform(F.filter(F.arrays_zip("_lines", "_flags"), lambda x: x["_flags"]), lambda x: x["_lines"])
    # Other lines become a mark, so what stands between two marks is a run.
    marked = F.array_join(F.zip_with("_lines", "_flags", lambda x, f: F.when(f, F.translate(x, "\x01", " ")).otherwise(F.lit("\x01"))), "\n")
    found = found.withColumn("_heads", heads).withColumn("_runs", F.when(F.size("_heads") > 1, F.split(marked, "\x01")).otherwise(F.array().cast("array<string>")))
    runs = F.filter(F.transform("_runs", lambda x: F.trim(F.translate(x, "\n", " "))), lambda x: x != "")
    share = F.size("_heads") / F.greatest(F.size("_lines"), F.lit(1))
    found = found.withColumn("n_headers", F.size("_heads").cast("long")).withColumn("is_file", F.rlike("path", F.lit(FILE_NAME)) | (share >= FILE_SHARE))
    whole = F.when(F.col("is_file"), F.array(F.array_join("_lines", " "))).otherwise(F.array().cast("array<string>"))
    ranked = lambda texts, rank: F.transform(texts, lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("line")))
    found = found.withColumn("headers", F.filter(F.array_distinct(F.concat(ranked(F.concat("_heads", runs), PART), ranked(whole, WHOLE))), lambda x: x["line"] != ""))
    return found.drop("_lines", "_flags", "_heads", "_runs", "text").withColumn("row_id", F.monotonically_increasing_id())


def match(lines: DataFrame, stage: Stage) -> DataFrame:
    """(line, licence, score) of the distinct lines that match a template.

    lines: (line, n), n being how many headers are this line.
    """
    spark = lines.sparkSession
    terms = lines.select("line", "n", F.explode(_terms(F.col("line"))).alias("term")).groupBy("line", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = stage.save(terms, "terms")
    total = lines.agg(F.sum("n").alias("total"))
    idf = terms.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(total)).select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = stage.save(idf, "idf")
    weights = stage.save(terms.join(idf, "term").select("line", "term", (F.col("tf") * F.col("idf")).alias("w")), "weights")
    norms = weights.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rows = [F.struct(F.lit(name).alias("licence"), F.lit(i).alias("k"), F.lit(text).alias("text")) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    own = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    own = own.select("licence", "k", F.explode(_terms(F.col("text"))).alias("term")).groupBy("licence", "k", "term").agg(F.count(F.lit(1)).alias("tf"))
    # The templates are constants: a few hundred terms at most.
    own = own.join(idf, "term", "left").select("licence", "k", "term", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("v"))
    size = own.groupBy("licence", "k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    dots = weights.join(F.broadcast(own), "term").groupBy("line", "licence", "k").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scores = dots.join(norms, "line").join(F.broadcast(size), ["licence", "k"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6))
    best = scores.where(F.col("score") >= LEAST).groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("neg"), "licence")).alias("m"))
    return best.select("line", F.col("m.licence").alias("licence"), (-F.col("m.neg")).alias("score"))


def nearest_directories(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, from_dir, licence) for directories with a licensed ancestor or themselves."""
    depth = F.size(F.split("dir", "/"))
    prefixes = directories.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
    prefixes = prefixes.select("dir", "depth", F.when(F.col("depth") == 0, "").otherwise(F.expr("substring_index(dir, '/', depth)")).alias("from_dir")).where("depth > 0 or dir <> ''")
    found = prefixes.join(licensed.select(F.col("dir").alias("from_dir"), "licence"), "from_dir")
    return found.groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "licence")).alias("m")).select("dir", F.col("m.from_dir").alias("from_dir"), F.col("m.licence").alias("inherited"))


def scan(files: DataFrame, path: Column, text: Column, keys: list[str]) -> DataFrame:
    """Per row of files: keys, path, n_headers, own licence and score, inherited, from_dir, licence."""
    stage = Stage(files.sparkSession, "licences")
    found = files.select(*keys, F.coalesce(path, F.lit("")).alias("path"), text.alias("text"))
    found = stage.save(headers(found), "headers")
    each = found.select("row_id", F.explode("headers").alias("h")).select("row_id", "h.rank", "h.line")
    lines = stage.save(each.groupBy("line").agg(F.count(F.lit(1)).alias("n")), "lines")
    scored = stage.save(match(lines, stage), "scored")
    own = each.join(scored, "line").groupBy("row_id").agg(F.min(F.struct("rank", (-F.col("score")).alias("neg"), "licence")).alias("m"))
    own = own.select("row_id", F.col("m.licence").alias("own"), (-F.col("m.neg")).alias("score"))
    directory = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    judged = found.select("row_id", *keys, "path", "is_file", "n_headers", directory.alias("dir")).join(own, "row_id", "left")
    judged = stage.save(judged, "judged")
    licensed = judged.where("is_file and own is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("neg"), "path", "own")).alias("m")).select("dir", F.col("m.own").alias("licence"))
    near = stage.save(nearest_directories(judged.select("dir").distinct(), licensed), "near")
    out = judged.join(near, "dir", "left")
    lacks = F.col("own").isNull()
    return out.select(
        *keys, "path", "n_headers", "own", "score",
        F.when(lacks, F.col("inherited")).alias("inherited"),
        F.when(lacks, F.col("from_dir")).alias("from_dir"),
        F.coalesce("own", "inherited").alias("licence"),
    )


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files source/lang/hundreds/doc_id.txt."""
    docs = documents(spark, sf_dir)
    path = F.concat_ws("/", "source", "lang", F.expr("cast(doc_id div 100 as string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs, path, F.col("text"), ["doc_id"])


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = lambda c: f"list_filter(regexp_extract_all(lower({c}), {quoted(TERM)}, 1), lambda y: y not in ({', '.join(map(quoted, STOP))}))"
    known = "[" + ", ".join(map(quoted, VOCABULARY)) + "]"
    templates = ", ".join(f"({quoted(n)}, {i}, {quoted(t)})" for n, ts in TEMPLATES.items() for i, t in enumerate(ts))
    return f"""
with f as (select doc_id, concat_ws('/', source, lang, (doc_id // 100)::varchar, doc_id || '.txt') as path,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') as ls from documents),
ln as (select doc_id, unnest(range(len(ls))) as i, unnest(ls) as line from f),
lt as (select *, list_distinct({found("line")}) as ts from ln),
lf as (select doc_id, i, line, len(ts) > 0 and len(list_intersect(ts, {known})) >= {HEADER_SHARE} * len(ts) as flag from lt),
hl as (select *, i - row_number() over (partition by doc_id order by i) as run from lf where flag),
hn as (select doc_id, count(*) as n_headers from hl group by 1),
g as (select f.doc_id, path, ls, regexp_replace(path, '/[^/]*$', '') as dir, coalesce(n_headers, 0) as n_headers,
  regexp_matches(path, {quoted(FILE_NAME)}) or coalesce(n_headers, 0) >= {FILE_SHARE} * greatest(len(ls), 1) as is_file from f left join hn using (doc_id)),
e as (select doc_id, {PART} as rank, line from hl union select doc_id, {PART}, trim(string_agg(line, ' ' order by i)) from hl group by doc_id, run having max(doc_id) in (select doc_id from hn where n_headers > 1)
  union select doc_id, {WHOLE}, array_to_string(ls, ' ') from g where is_file and len(ls) > 0),
l as (select line, count(*) as n from e group by line),
t as (select line, n, term, count(*) as tf from (select line, n, unnest({found("line")}) as term from l) group by all),
i as (select term, ln((1 + (select sum(n) from l)) / (1 + sum(n))) + 1 as idf from t group by term),
w as (select line, term, tf * idf as w from t join i using (term)),
nl as (select line, sqrt(sum(w * w)) as norm from w group by line),
tt as (select licence, k, term, count(*) as tf from (select licence, k, unnest({found("txt")}) as term from (values {templates}) x(licence, k, txt)) group by all),
v as (select licence, k, term, tf * coalesce(idf, 1.0) as v from tt left join i using (term)),
nv as (select licence, k, sqrt(sum(v * v)) as size from v group by all),
s as (select line, licence, round(dot / (norm * size), 6) as score from (select line, licence, k, sum(w * v) as dot from w join v using (term) group by all) join nl using (line) join nv using (licence, k)),
b as (select line, licence, score from s where score >= {LEAST} qualify row_number() over (partition by line order by score desc, licence) = 1),
o as (select doc_id, licence as own, score from e join b using (line) qualify row_number() over (partition by doc_id order by rank, score desc, licence) = 1),
j as (select g.doc_id, path, dir, is_file, n_headers, own, score from g left join o using (doc_id)),
d as (select dir as from_dir, own as inherited from j where is_file and own is not null qualify row_number() over (partition by dir order by score desc, path, own) = 1),
a as (select dir, from_dir, inherited from (select distinct dir from j) x join d on d.from_dir = x.dir or starts_with(x.dir, d.from_dir || '/')
  qualify row_number() over (partition by dir order by length(from_dir) desc) = 1)
select doc_id, path, n_headers, own, score, case when own is null then inherited end as inherited, case when own is null then from_dir end as from_dir, coalesce(own, inherited) as licence
from j left join a using (dir)
"""


SQL = _sql()
