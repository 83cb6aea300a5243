"""License scans with a positional rare-token index, in DataFrame functions alone.

Templates are openings and whole notices of licences, each with a mandatory key phrase and a label. Their words make the licence vocabulary,
whose document frequencies are counted over the whole corpus, and the index posts each template under the rarest word of
its key phrase, with that word's position.

Each file looks up its licence words, and of the templates whose key phrase it can hold, the posted (highest-IDF) word.
Every place of that word, less the posted position, is where the template would start; postings of the template's other
words are intersected with the file's words by relative position. A place counts if all words of the key phrase stand
where they must. Its score is the IDF of the template words that stand in place over that of all, and a file's score is
its best one. The base phrases are templates too, with nothing but a key phrase.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Files without a candidate, most of them, are
not looked at word by word.

Defined cases: null text is empty; without words n_words is 0; without places the counts are 0, first and last null,
labels empty strings, and the score 0; repeated rows return repeated rows; null ids are kept; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Openings and notices of public licences, as (template, key phrase, label).
TEMPLATES = (
    ("licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("licensed under the mozilla public license", "mozilla public license", "mpl"),
    ("licensed under the eclipse public license", "eclipse public license", "epl"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc by nd", "cc-by-nd"),
    ("creative commons attribution international license", "creative commons attribution", "cc-by"),
    ("released under the isc license", "isc license", "isc"),
    ("released under the bsd license", "bsd license", "bsd"),
    ("dedicated to the public domain", "public domain", "public-domain"),
    ("all rights reserved", "all rights reserved", "all-rights-reserved"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software the "
        "software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
        "authors or copyright holders be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings "
        "in the software",
        "permission is hereby granted free of charge",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software "
        "is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        "permission to use copy modify and or distribute this software for any purpose",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "redistribution and use in source and binary forms",
        "bsd",
    ),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer",
        "redistributions of source code must retain the above copyright notice",
        "bsd",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license",
        "you may not use this file except in compliance with the license",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for "
        "more details you should have received a copy of the gnu general public license along with this program",
        "published by the free software foundation either version 3",
        "gpl-3.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 2 of the license or at your option any later "
        "version",
        "published by the free software foundation either version 2",
        "gpl-2.0",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
        "subject to the terms of the mozilla public license",
        "mpl",
    ),
    (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely subject to the following restrictions",
        "permission is granted to anyone to use this software for any purpose including commercial applications",
        "zlib",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software",
        "free and unencumbered software released into the public domain",
        "unlicense",
    ),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _templates() -> list[dict]:
    own = [{"words": t.split(), "key": k.split(), "label": label, "base": False} for t, k, label in TEMPLATES]
    base = [{"words": k.split(), "key": k.split(), "label": label, "base": True} for k, label in BASE.items()]
    for t in base + own:
        t["skip"] = next(i for i in range(len(t["words"])) if t["words"][i : i + len(t["key"])] == t["key"])
    return base + own


def words_of(text) -> F.Column:
    """The words; [''] where there are none. Only two characters lower to ASCII letters besides A-Z, and they must not."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K")), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.split(F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ")


def _worded(docs: DataFrame) -> DataFrame:
    """(doc_id, words, n_words, found): found are the distinct licence words. The generators keep words from being made twice."""
    vocabulary = sorted({w for t in _templates() for w in t["words"]})
    w = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.explode(F.array(words_of(docs["text"]))).alias("words"))
    n = F.when(F.col("words")[0] == "", 0).otherwise(F.size("words")).cast("long").alias("n_words")
    known = F.from_json(F.lit(json.dumps(vocabulary)), "array<string>")
    return w.select("doc_id", "words", n, F.explode(F.array(F.array_intersect("words", known))).alias("found"))


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and how many hold each licence word: a row a word of the fixed vocabulary reaches the driver."""
    counted = _worded(docs).select(F.explode(F.concat("found", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    n = {r["w"]: r["n"] for r in counted.collect()}
    return n.pop("", 0), n


_INDEX = "array<struct<words: array<string>, idf: array<double>, all: double, key: array<string>, rare: string, at: int, skip: int, label: string, base: boolean>>"


def _index(n: int, df: dict[str, int]) -> F.Column:
    """The templates as one literal: words, their IDF, key phrase, posted word and its position."""
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1
    rows = []
    for t in _templates():
        at = max(range(len(t["key"])), key=lambda i: (idf(t["key"][i]), -i))
        weights = [idf(w) for w in t["words"]]
        rows.append(t | {"idf": weights, "all": sum(weights), "rare": t["key"][at], "at": at})
    return F.from_json(F.lit(json.dumps(rows)), _INDEX)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    index = _index(*frequencies(docs))
    words = F.col("words")
    able = F.filter(index, lambda t: F.size(F.array_except(t["key"], F.col("found"))) == 0)
    w = _worded(docs).select("doc_id", "words", "n_words", F.explode(F.array(F.when(F.size("found") > 0, able))).alias("able"))

    def in_place(start, t):
        """IDF of the template's words that stand where they must, of those inside the file."""
        first = start - t["skip"]
        there = F.sequence(first, first + F.size(t["words"]) - 1)
        same = lambda x, i: F.when((i >= 0) & (i < F.size(words)), F.get(words, i) == x).otherwise(F.lit(False))
        each = F.zip_with(t["words"], there, same)
        return F.aggregate(F.zip_with(each, t["idf"], lambda ok, v: F.when(ok, v).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, b: a + b) / t["all"]

    def places(t):
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == t["rare"])
        starts = F.filter(F.transform(at, lambda i: i - t["at"]), lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, F.size(t["key"])) == t["key"]))
        return F.transform(starts, lambda s: F.struct(s.cast("long").alias("start"), t["label"].alias("label"), t["base"].alias("base"), in_place(s, t).alias("score")))

    found = F.when(F.size("able") > 0, F.flatten(F.transform("able", places)))
    w = w.select("doc_id", "n_words", F.explode(F.array(found)).alias("p"))
    p = F.coalesce("p", F.expr("cast(array() as array<struct<start: bigint, label: string, base: boolean, score: double>>)"))
    base = F.filter(p, lambda x: x["base"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    cells = {
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": labels(base),
        "labels": labels(p),
        "score": F.coalesce(F.array_max(F.transform(p, lambda x: x["score"])), F.lit(0.0)),
    }
    return w.select("doc_id", "n_words", *[c.alias(n) for n, c in cells.items()])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 9))


def _values() -> str:
    words = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"
    rows = enumerate(_templates())
    return ",\n    ".join(f"({i}, {words(t['words'])}, {words(t['key'])}, {t['skip']}, '{t['label']}', {t['base']})" for i, t in rows)


#: Every place of every key phrase, looked for word by word.
OP10_SQL = rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT * FROM (VALUES {_values()}) t(tid, words, key, skip, label, base)),
held AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS word FROM w) GROUP BY word),
every AS (SELECT tid, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM t),
idf AS (SELECT tid, list(ln(cast((SELECT count(*) FROM w) + 1 AS DOUBLE) / (coalesce(df, 0) + 1)) + 1 ORDER BY k) AS idf FROM every e LEFT JOIN held h ON e.word = h.word GROUP BY tid),
able AS (SELECT w.r, w.w, t.*, idf.idf FROM w JOIN t ON list_has_all(w.w, t.key) JOIN idf ON t.tid = idf.tid),
place AS (SELECT * FROM (SELECT *, unnest(range(1, len(w) - len(key) + 2)) AS p FROM able) WHERE w[p:p + len(key) - 1] = key),
scored AS (
  SELECT r, label, base, p - 1 AS start, list_reduce(list_transform(range(1, len(words) + 1), lambda k:
    CASE WHEN p - skip + k - 1 BETWEEN 1 AND len(w) AND w[p - skip + k - 1] = words[k] THEN idf[k] ELSE 0.0::DOUBLE END), lambda a, b: a + b)
    / list_reduce(idf, lambda a, b: a + b) AS score FROM place),
told AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM scored GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(coalesce(score, 0.0::DOUBLE), 9) AS score
FROM w LEFT JOIN told ON w.r = told.r
"""
