"""License scans: sparse TF-IDF cosine of headers and license files to templates, then inheritance.

Every text is cut into statements: its lines cut at the ends of sentences, and its sentences with line breaks as blanks. Only those that hold a cue are compared: a cue is a
template's word without which its other, lighter words have too little of its weight to reach the threshold,
so no statement that could reach it is passed over. A statement's sparse vector, words weighted by count and inverse document frequency, is compared with the
templates' by cosine. Document frequencies of the templates' words are counted over all documents; a
word that no template has weighs as one that no document has. Each statement with a cosine of at least `threshold` to a license's template speaks
for that license by its words, times how far the cosine is from the threshold to 1; a document's license is the one for which its statements speak most. So
a text that quotes another license in passing, or shares sentences with one, has its own. A document is a license file if its name
says so, or if it is little else than license: FILE_WORDS words or more, FILE_SHARE of them in statements of its license.

The built-in templates (TEMPLATES) are the statements by which texts name their license, titles of licenses, and the whole texts of short
ones. A long license is told by its title; that a text without a telling name is that license as a whole can be seen only if its
text is among the templates: whole_texts() reads such from a folder, for scan(templates=...).

A document without a license of its own takes that of the nearest directory above it that
has a license file. Directories, not documents, are joined with their ancestors.

Defined results: null and empty texts have no license of their own; a null path is the empty one, whose
directory is the root; ties go to the higher cosine, then the license that sorts first, of two license files in a
directory the smaller doc_id; repeated rows each give a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm._shared import cut, join_checked, let

# Statements by which texts name their license, titles, and the statements of short license texts.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
    " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "You may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,"
        " and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _AS_IS,
    ],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["Released under the zlib License.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3, 29 June 2007", "GNU General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3, 29 June 2007", "GNU Lesser General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License Version 3, 19 November 2007", "GNU Affero General Public License Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."],
    "GPL-1.0": ["GNU General Public License Version 1, February 1989", "GNU General Public License Version 1, February 1989 Copyright (C) 1989 Free Software Foundation, Inc."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License Version 2, June 1991", "GNU General Public License Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."],
    "LGPL-2.0": ["GNU Library General Public License Version 2, June 1991", "GNU Library General Public License Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU Lesser General Public License Version 2.1, February 1999", "GNU Lesser General Public License Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."],
    "GFDL-1.2": ["GNU Free Documentation License Version 1.2, November 2002", "GNU Free Documentation License Version 1.2, November 2002 Copyright (C) 2000, 2001, 2002 Free Software Foundation, Inc."],
    "GFDL-1.3": ["This work is licensed under the GNU Free Documentation License, version 1.3.", "GNU Free Documentation License Version 1.3, 3 November 2008", "GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc."],
    "Artistic-1.0": [
        "Released under the Artistic License.",
        "The \"Artistic License\" Preamble The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package,"
        " while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications.",
        "THIS PACKAGE IS PROVIDED \"AS IS\" AND WITHOUT ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, WITHOUT LIMITATION, THE IMPLIED WARRANTIES OF MERCHANTIBILITY AND FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "MPL-1.1": [
        "Mozilla Public License Version 1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1",
        "Software distributed under the License is distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied.",
        "See the License for the specific language governing rights and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0, dedicated to the public domain.", "Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"],
}
# Possessive throughout: a plain group repeated over a long text would overflow the stack.
STATEMENT = r"[^\n.!?;|]*+(?:[.](?=[0-9])[^\n.!?;|]*+)*+[.!?;|\n]?"
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)(?:[.-][^/]*)?$"
THRESHOLD = 0.75
WORD_RUN = r"[\p{L}\p{N}]+"
#: A text without a telling name is a license file if so much of it, and so many words, are license statements.
FILE_SHARE, FILE_WORDS = 0.9, 20
#: Words of a statement of a whole text at least, for it to be a template.
LEAST_WORDS = 4


def _words(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), F.lit(0))


def whole_texts(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Templates from a folder of license texts, a file each, named as the license: the statements of every text of FILE_WORDS words or more.

    Statements with few words are left out, but for the text's beginning. They are held by the driver, as templates are.
    """
    texts = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.txt)?$", 1).alias("name"), F.regexp_replace("value", r"\s+", " ").alias("text"))
    cut_up = texts.where(F.size(_words("text")) >= FILE_WORDS).select("name", F.filter(F.regexp_extract_all("text", F.lit(STATEMENT), F.lit(0)), lambda s: F.size(_words(s)) > 0).alias("s"))
    return {r["name"]: r["s"] for r in cut_up.select("name", F.filter("s", lambda s, i: (F.size(_words(s)) >= LEAST_WORDS) | (i == 0)).alias("s")).collect()}


def _templates(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    rows = [(k, i, t) for k, texts in sorted(templates.items()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "license string, form int, text string")


def _literal(words: list[str]) -> F.Column:
    """A literal array of words, which are letters and digits, as one expression."""
    listed = ", ".join(f"'{w}'" for w in sorted(words))
    return F.expr(f"cast(array({listed}) AS array<string>)")


def weights(docs: DataFrame, templates: dict[str, list[str]]) -> tuple[DataFrame, float]:
    """The templates' words with their idf over docs, and the idf of a word that no document has."""
    spark = docs.sparkSession
    words = [r[0] for r in _templates(spark, templates).select(F.explode(_words("text")).alias("w")).distinct().collect()]
    known = _literal(words)
    held = docs.select(F.array_intersect(_words("text"), known).alias("w"))
    n = docs.count()
    counts = held.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    vocabulary = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    idf = F.log((F.lit(float(n)) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    rare = spark.range(1).select(F.log(F.lit(float(n)) + 1) + 1).first()[0]
    return cut(vocabulary.join(counts, "word", "left").select("word", idf.alias("idf")), "idf"), rare


def _vectors(statements: DataFrame, idf: DataFrame, rare: float, keys: list[str]) -> DataFrame:
    """keys, word, weight (known words only) and the norm over all words of each statement."""
    counted = statements.select(*keys, F.explode(_words("text")).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("tf"))
    weighed = counted.join(F.broadcast(idf), "word", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    return weighed.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        F.sum("tf").alias("n"),
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "weight"))).alias("terms"),
    )


def cues(forms: DataFrame, threshold: float = THRESHOLD, idf: dict[str, float] | None = None) -> list[str]:
    """Words of which every statement within threshold of a template has some.

    A cosine is at most the norm of the template's part that the statement shares, over the template's. So words may go
    that have less than the threshold of it together; the most common ones go first, as they would let the most statements through.
    """
    held: dict[int, list[tuple[float, str]]] = {}
    for r in forms.select("form", "word", (F.col("t_weight") / F.col("t_norm")).alias("w")).collect():  # as many as the templates have words
        held.setdefault(r["form"], []).append((r["w"] ** 2, r["word"]))
    heavy, least = set(), max(0.0, threshold - 1e-6) ** 2 - 1e-9  # scores are rounded
    for terms in held.values():
        light = 0.0
        for share, word in sorted(terms, key=lambda t: ((idf or {}).get(t[1], 0.0), t)):
            light += share
            if light >= least:
                heavy.add(word)
    return sorted(heavy)


def scan(docs: DataFrame, *, threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """doc_id, path, license, score, origin (header, file, inherited or none) of docs (doc_id, path, text).

    templates: statements by license; what the driver and each task hold of them is bounded by their own size.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), "text")
    idf, rare = weights(docs, templates)
    # The templates' vectors: their number is that of the caller's templates, so they are broadcast.
    forms = _vectors(_templates(spark, templates), idf, rare, ["license", "form"])
    forms = forms.select("license", F.col("norm").alias("t_norm"), F.explode("terms").alias("t")).select("license", "t_norm", "t.word", F.col("t.weight").alias("t_weight"), F.xxhash64("license", "t_norm").alias("form"))
    forms = cut(forms, "forms")

    heavy = _literal(cues(forms, threshold, {r["word"]: r["idf"] for r in idf.collect()}))  # as many as the templates have words

    def cued(kind: int, text) -> F.Column:
        held = F.filter(F.regexp_extract_all(text, F.lit(STATEMENT), F.lit(0)), lambda s: F.arrays_overlap(_words(s), heavy))
        return F.transform(held, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("text")))

    def found(words) -> F.Column:
        flowing = F.regexp_replace("text", r"\s+", " ")
        both = F.concat(cued(0, F.col("text")), cued(1, flowing))
        none = F.array().cast("array<struct<kind:int,text:string>>")
        return F.when(F.arrays_overlap(words, heavy), F.struct(both.alias("statements"), F.size(words).alias("n_words"))).otherwise(F.struct(none.alias("statements"), F.lit(0).alias("n_words")))

    rows = docs.select("doc_id", "path", F.xxhash64("text").alias("uid"), let(F.coalesce(_words("text"), F.array().cast("array<string>")), found).alias("f"))
    rows = cut(rows.select("doc_id", "path", "uid", "f.*"), "statements")
    texts = rows.select(F.explode("statements.text").alias("text")).distinct()
    vectors = cut(_vectors(texts, idf, rare, ["text"]), "vectors")
    terms = vectors.select("text", "norm", "n", F.explode("terms").alias("t"))
    dots = terms.join(F.broadcast(forms), terms["t.word"] == forms["word"]).groupBy("text", "n", "norm", "license", "form", "t_norm")
    cosines = dots.agg(F.sum(F.col("t.weight") * F.col("t_weight")).alias("dot")).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6))
    best = cut(cosines.where(F.col("score") >= threshold).groupBy("text", "n", "license").agg(F.max("score").alias("score")), "best")

    spread = rows.where(F.size("statements") > 0).select("doc_id", "path", "uid", "n_words", F.explode("statements").alias("s")).select("doc_id", "path", "uid", "n_words", "s.*")
    document = ["doc_id", "path", "uid", "n_words"]
    # A text's statements are cut in two ways: a license counts by the way that says more for it.
    speaks = F.round(F.sum(F.col("n") * (F.col("score") - threshold + 1e-6) / (1 - threshold + 1e-6)), 6)
    ways = spread.distinct().join(best, "text").groupBy(*document, "license", "kind").agg(speaks.alias("speaks"), F.sum("n").alias("covered"), F.max("score").alias("score"))
    each = ways.groupBy(*document, "license").agg(F.max("speaks").alias("speaks"), F.max("covered").alias("covered"), F.max("score").alias("score"))
    named = each.groupBy(*document).agg(F.min(F.struct((-F.col("speaks")).alias("s"), (-F.col("score")).alias("c"), "license", "covered")).alias("b"))
    is_file = F.col("path").rlike(FILE_NAME) | ((F.col("n_words") >= FILE_WORDS) & (F.col("b.covered") >= FILE_SHARE * F.col("n_words")))
    named = cut(named.select("doc_id", "path", "uid", "b.license", (-F.col("b.c")).alias("score"), is_file.alias("is_file")), "named")

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    own = named.where("is_file").groupBy(folder.alias("at")).agg(F.min(F.struct("doc_id", "license", "score")).alias("l"))
    own = cut(own.select("at", "l.license", "l.score"), "licensed")
    folders = rows.select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(parts))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at")))
    climbs = folders.select("folder", F.explode(above).alias("a")).select("folder", "a.depth", "a.at")
    nearest = join_checked(climbs, own, "at", "inner").groupBy("folder").agg(F.max_by(F.struct("license", "score"), "depth").alias("from"))
    nearest = cut(nearest, "nearest")

    base = rows.select("doc_id", "path", "uid", folder.alias("folder"))
    keys = [base[k].eqNullSafe(named[k]) for k in ("doc_id", "path", "uid")]
    joined = base.join(named, keys[0] & keys[1] & keys[2], "left").select(base["doc_id"], base["path"], "folder", "license", "score", "is_file")
    joined = join_checked(joined, nearest, "folder")
    origin = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    return joined.select("doc_id", "path", F.coalesce("license", "from.license").alias("license"), F.coalesce("score", "from.score").alias("score"), origin.alias("origin"))


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path, text of documents, with source/lang/doc_id.txt as the path."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in ("source", "lang", "doc_id")]
    return docs.select("doc_id", F.concat(F.concat_ws("/", *parts), F.lit(".txt")).alias("path"), "text")
