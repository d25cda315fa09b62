"""License scan: TF-IDF cosine to license templates, then inheritance from the
nearest directory above (DataFrame functions only).

Terms are lower-cased runs of ASCII letters and digits (dots between digits). Templates
are TF-IDF vectors; a line (header) or a whole file is compared by cosine in
the space of template terms; a term outside of it lengthens the line by 1. Document
frequencies cover all files. A line can
only reach ``threshold`` if it holds a *signal* term: the terms with the
smallest weights of a template, whose squares together stay below
threshold^2, can't do it alone. So lines without signal terms are not compared,
and no match is lost.

A file whose license lines hold at least ``file_share`` of its words, or whose
name says so (LICENSE, LICENCE, COPYING, NOTICE), is a license file: its
license holds for its directory and, where no nearer one does, for everything
below, found by joining each directory with all its ancestors.

Defined results: null text counts as empty, a null path as a file in the top
directory; a file's own license (its best line; ties to the smaller license
name) goes before an inherited one; of several license files in one directory
the higher score, then the smaller license name, counts; files without either
have license null and origin ``none``; repeated rows come back as given; an
empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import fresh_columns, plain_columns, row_key, written

# Usual short statements of public licenses.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause Simplified License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause New or Revised License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
}
NAMES = r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$"
_TERM = r"[a-z0-9]+(?:[.][0-9]+)*"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def template_terms(templates: dict[str, str]) -> dict[str, Counter]:
    return {name: Counter(re.findall(_TERM, t.lower())) for name, t in templates.items()}


def _directory(path: Column) -> Column:
    """The directory of a path, without a slash at the end; '' is the top."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, str] | None = None,
         threshold: float = 0.85, file_share: float = 0.5) -> DataFrame:
    """``files`` (other columns kept, text left out) with license, origin
    (header, file, inherited or none), score and license_dir (where it is
    inherited from)."""
    counted = template_terms(templates or TEMPLATES)
    vocabulary = sorted({t for c in counted.values() for t in c})
    added = ("license", "origin", "score", "license_dir")
    files = fresh_columns(files, *added)
    keys = dict(zip(("__k1", "__k2"), row_key(*plain_columns(files))))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    known = F.array(*[F.lit(v) for v in vocabulary])

    # document frequencies of the template terms over all files (a bounded list)
    hits = files.select(F.explode(F.array_intersect(terms(t), known)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = files.count()
    df = {r["term"]: r["n"] for r in hits.collect()}
    idf = {v: math.log((1 + total) / (1 + df.get(v, 0))) + 1 for v in vocabulary}
    vectors = {name: {v: n * idf[v] for v, n in c.items()} for name, c in counted.items()}
    norms = {name: math.sqrt(sum(w * w for w in v.values())) for name, v in vectors.items()}
    signal: set[str] = set()
    for name, v in vectors.items():
        weak = 0.0
        for term, w in sorted(v.items(), key=lambda x: x[1]):
            weak += w * w
            if weak >= threshold ** 2 * norms[name] ** 2:
                signal.add(term)
    spark = files.sparkSession
    weights = spark.createDataFrame([(v, name, w / norms[name], idf[v]) for name, x in vectors.items() for v, w in x.items()],
                                    "term string, license string, w double, idf double")
    idfs = spark.createDataFrame([(v, idf[v]) for v in vocabulary], "term string, idf double")

    # lines with a signal term, as (file, line, term, count) in the templates' space
    lines = files.withColumns(keys).select("__k1", "__k2", F.posexplode(F.filter(
        F.transform(F.split(t, "\n", -1), lambda x: F.struct(terms(x).alias("t"), x.alias("x"))),
        lambda x: F.arrays_overlap(x["t"], F.array(*[F.lit(s) for s in sorted(signal)])))).alias("line", "x"))
    lines = written(lines.select("__k1", "__k2", "line", F.col("x.t").alias("t"), F.size(F.filter(F.split("x.x", r"\s+"), lambda w: w != "")).alias("words")).distinct(), "license-lines")
    counts = lines.select("__k1", "__k2", "line", F.explode("t").alias("term")).groupBy("__k1", "__k2", "line", "term").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(F.broadcast(idfs), "term")
    size = counts.groupBy("__k1", "__k2", "line").agg(F.sqrt(F.sum(F.col("n") * F.col("n") * F.col("idf") * F.col("idf"))).alias("size"))
    # every term of the line counts in its length; those outside the templates weigh one idf of 1
    other = lines.select("__k1", "__k2", "line", "words", F.size(F.filter("t", lambda x: ~F.array_contains(known, x))).alias("others"))
    dots = counts.drop("idf").join(F.broadcast(weights), "term").groupBy("__k1", "__k2", "line", "license").agg(F.sum(F.col("n") * F.col("idf") * F.col("w")).alias("dot"))
    scored = (dots.join(size, ["__k1", "__k2", "line"]).join(other, ["__k1", "__k2", "line"])
              .withColumn("score", F.round(F.col("dot") / F.sqrt(F.col("size") * F.col("size") + F.col("others")), 9))
              .where(F.col("score") >= threshold))
    best = F.max_by(F.struct("license", "score", "words"), F.struct("score", F.expr("transform(split(license, ''), x -> -ascii(x))")))
    headers = scored.groupBy("__k1", "__k2", "line").agg(best.alias("b")).select("__k1", "__k2", "b.*")
    own = headers.groupBy("__k1", "__k2").agg(
        F.max_by(F.struct("license", "score"), F.struct("score", F.expr("transform(split(license, ''), x -> -ascii(x))"))).alias("o"),
        F.sum("words").alias("licensed")).select("__k1", "__k2", "o.license", "o.score", "licensed")
    own = written(own, "license-own")

    place = F.col(f"`{path}`")
    # words by the spaces between them: no array of the whole text
    words = F.regexp_count(t, F.lit(r"\S+"))
    slim = files.withColumns(keys).select(*[F.col(f"`{c}`") for c in files.columns if c != text], "__k1", "__k2",
                                          _directory(place).alias("__dir"), F.coalesce(F.regexp_extract(place, r"[^/]*$", 0), F.lit("")).alias("__name"), words.alias("__words"))
    slim = slim.join(own, ["__k1", "__k2"], "left")
    is_file = F.col("license").isNotNull() & (F.col("__name").rlike(NAMES) | (F.col("licensed") >= file_share * F.col("__words")))
    slim = written(slim.withColumn("__is_file", F.coalesce(is_file, F.lit(False))), "license-files")

    rules = (slim.where("__is_file").groupBy("__dir").agg(F.max_by(F.struct("license", "score"), F.struct("score", F.expr("transform(split(license, ''), x -> -ascii(x))"))).alias("r"))
             .select(F.col("__dir").alias("above"), F.col("r.license").alias("__license"), F.col("r.score").alias("__score")))
    # every directory with all its ancestors; a directory is one row however many files it has
    parts = F.split("__dir", "/")
    chain = F.concat(F.array(F.lit("")), F.filter(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/")), lambda d: d != ""))
    above = (slim.where("license is null").select("__dir").distinct().select("__dir", F.explode(F.array_distinct(chain)).alias("above"))
             .join(rules, "above").groupBy("__dir").agg(F.max_by(F.struct("above", "__license", "__score"), F.char_length("above")).alias("n"))
             .select("__dir", F.col("n.above").alias("__above"), F.col("n.__license").alias("__license"), F.col("n.__score").alias("__score")))
    out = slim.join(above, "__dir", "left")
    return out.select(*[F.col(f"`{c}`") for c in files.columns if c != text],
                      F.coalesce("license", "__license").alias("license"),
                      F.when(F.col("__is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("__license").isNotNull(), "inherited").otherwise("none").alias("origin"),
                      F.coalesce("score", "__score", F.lit(0.0)).alias("score"),
                      F.when(F.col("license").isNull(), F.col("__above")).alias("license_dir"))


def as_files(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Documents as files ``source/<id div 1000>/<id div 100>/<id>.txt``: the
    tables have no paths, ids that are near each other stand in one directory."""
    i = F.col(f"`{doc_id}`")
    piece = lambda n: F.coalesce(F.floor(i / n).cast("string"), F.lit("none"))
    return docs.select(i.alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.concat_ws("/", F.coalesce(F.col(f"`{source}`"), F.lit("none")), piece(1000), piece(100),
                                   F.concat(F.coalesce(i.cast("string"), F.lit("none")), F.lit(".txt"))).alias("path"))
