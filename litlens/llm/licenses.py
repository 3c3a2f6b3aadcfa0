"""License scan by diagonal voting. DataFrame functions only.

Templates are phrases with labels. Every rolling pair of a document's words is hashed and joined to the hashes of the
templates' pairs; the words themselves are compared behind the hash, so a hit is exact. A hit at word p of the document and
word q of the template votes for the diagonal p - q, where the template would begin. Votes are counted as bits, one for each
pair of the template, so repeated hits count once. Neighbouring diagonals, at most `slack` apart, are merged: words that were
left out or put in shift the rest of a notice by a few places. A diagonal whose merged votes cover at least `share` of the
template's pairs, and no less than its neighbours', is a span. Base templates are found only where all their words stand
consecutively: all votes on one diagonal.

Votes are grouped by document, template and diagonal after counting within tasks, so copies, hot words and long documents
spread; a window sees the diagonals of one template in one document. The templates are broadcast if they have at most
`max_broadcast` pairs.

Defined cases: null texts are empty; a document's rows are told apart by id and text, and rows that repeat both share their
result; templates of one word have no pair and are refused; longer ones than LONGEST words are cut into pieces of that length,
each a template with the same label; very long texts are one array of words in their task; kept columns named as a result are
replaced.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litlens.llm.common import read_table

#: (phrase, label): the base templates (fixed values of the query's contract).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (phrase, label): opening or naming words of well-known public licenses.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution license", "cc"),
    ("this program is free software you can redistribute it and or modify it", "gpl-notice"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl-notice"),
)
#: Whatever is no word, once A-Z are a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before that.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Pairs of a template are the bits of a long.
LONGEST = 60
KEYS = ("_k1", "_k2")


def words(text: Column) -> Column:
    """The words in lower case. The Kelvin sign is the one other letter whose lower case is in ASCII."""
    plain = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))
    return F.filter(F.split(plain, GAP), lambda w: w != "")


def templates(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """(phrase, label, is_base) of the given templates."""
    rows = [F.struct(F.lit(p).alias("phrase"), F.lit(x).alias("label"), F.lit(b).alias("is_base")) for some, b in ((base, True), (notices, False)) for p, x in some]
    return spark.range(1).select(F.inline(F.array(*rows)))


def pairs(known: DataFrame) -> DataFrame:
    """(t, label, is_base, q, n, w1, w2, h): each pair of each template; n is the template's number of pairs."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0)), F.lit(LONGEST)), lambda i: F.slice("w", i + 1, LONGEST))
    pieces = known.withColumn("w", words(F.col("phrase"))).select("label", "is_base", F.explode(F.when(F.col("is_base"), F.array("w")).otherwise(cut)).alias("w")).filter("size(w) > 1").distinct()
    t = F.xxhash64("label", "is_base", F.array_join("w", " "))
    n = F.size("w") - 1
    sure = F.when(F.col("is_base") & (n > LONGEST), F.raise_error(F.lit(f"a base template has more than {LONGEST + 1} words")).cast("int")).otherwise(n)
    at = pieces.select(t.alias("t"), "label", "is_base", sure.alias("n"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("q"))
    w1, w2 = F.get("w", F.col("q")), F.get("w", F.col("q") + 1)
    return at.select("t", "label", "is_base", "q", "n", w1.alias("w1"), w2.alias("w2"), F.xxhash64(w1, w2).alias("h"))


def _keys(id_: str, text: str) -> list[Column]:
    """128 bits for a row's id and text."""
    both = [F.coalesce(F.col(id_).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))]
    return [F.xxhash64(*both).alias(KEYS[0]), F.xxhash64(F.lit(1), *both).alias(KEYS[1])]


def hits(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast: int = 100_000) -> DataFrame:
    """(_k1, _k2, t, label, is_base, n, p, q): every pair of words of docs that is a pair of a template."""
    found = pairs(known)
    if found.limit(max_broadcast + 1).count() <= max_broadcast:
        found = F.broadcast(found)
    rows = docs.select(*_keys(key, text), words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    rolled = F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_w", i + 1)))
    rolled = rows.select(*KEYS, "_w", F.posexplode(rolled).alias("p", "h"))
    same = (F.get("_w", F.col("p")) == F.col("w1")) & (F.get("_w", F.col("p") + 1) == F.col("w2"))
    return rolled.join(found, (rolled["h"] == found["h"]) & same).select(*KEYS, "t", "label", "is_base", "n", "p", "q")


def spans(found: DataFrame, slack: int = 2, share: float = 0.75) -> DataFrame:
    """(_k1, _k2, label, is_base, start, n_words, score) of hits: base templates in full, others as the best of neighbouring
    diagonals."""
    # two longs a group; a set would be sorted
    votes = found.groupBy(*KEYS, "t", "label", "is_base", "n", (F.col("p") - F.col("q")).alias("start")).agg(F.expr("bit_or(shiftleft(1L, q))").alias("bits"))
    near = Window.partitionBy(*KEYS, "t").orderBy("start")
    votes = votes.withColumn("score", F.bit_count(F.bit_or("bits").over(near.rangeBetween(-slack, slack))) / F.col("n"))
    left, right = F.max("score").over(near.rangeBetween(-slack, -1)), F.max("score").over(near.rangeBetween(1, slack))
    peak = (F.col("score") > F.coalesce(left, F.lit(-1.0))) & (F.col("score") >= F.coalesce(right, F.lit(-1.0)))
    full = F.bit_count("bits") == F.col("n")
    votes = votes.withColumns({"_full": full, "_peak": peak}).filter(F.when(F.col("is_base"), F.col("_full")).otherwise(F.col("_peak") & (F.col("score") >= share)))
    return votes.select(*KEYS, "label", "is_base", "start", (F.col("n") + 1).alias("n_words"), F.when(F.col("is_base"), F.lit(1.0)).otherwise(F.col("score")).alias("score"))


RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None, slack: int = 2, share: float = 0.75, max_broadcast: int = 100_000) -> DataFrame:
    """keep (all columns of docs unless given) with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    keep = tuple(c for c in (keep or docs.columns) if c not in RESULTS)
    base = F.col("is_base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    of_doc = spans(hits(docs, known, key, text, max_broadcast), slack, share).groupBy(*KEYS).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("score").alias("score"),
    )
    rows = docs.select(F.struct(*keep).alias("_row"), *_keys(key, text), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    filled = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = rows.join(of_doc, list(KEYS), "left")
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], *[F.coalesce(F.col(c), filled[c]).alias(c) if c in filled else F.col(c) for c in RESULTS])


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), templates(spark), keep=("doc_id",))


def _oracle(base=BASE, notices=NOTICES, slack: int = 2, share: float = 0.75) -> str:
    known = ", ".join(f"('{p}', '{x}', {b})" for some, b in ((base, True), (notices, False)) for p, x in some)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH templates(phrase, label, is_base) AS (VALUES {known}),
pairs AS (SELECT phrase, label, is_base, len(w) - 1 AS n, unnest(range(len(w) - 1)) AS q, w FROM (SELECT *, string_split(phrase, ' ') AS w FROM templates)),
grams AS (SELECT phrase, label, is_base, n, q, w[q + 1] AS w1, w[q + 2] AS w2 FROM pairs),
docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT row, unnest(range(len(w))) AS p, unnest(w) AS w1, unnest(list_concat(w[2:], [NULL])) AS w2 FROM docs),
votes AS (SELECT row, phrase, label, is_base, n, p - q AS start, list(DISTINCT q) AS qs FROM words JOIN grams USING (w1, w2) GROUP BY ALL),
merged AS (SELECT v.row, v.phrase, v.label, v.is_base, v.n, v.start, len(v.qs) = v.n AS is_full, len(list_distinct(flatten(list(o.qs)))) / v.n AS score
  FROM votes v JOIN votes o ON o.row = v.row AND o.phrase = v.phrase AND o.start BETWEEN v.start - {slack} AND v.start + {slack} GROUP BY v.row, v.phrase, v.label, v.is_base, v.n, v.start, v.qs),
spans AS (SELECT row, label, is_base, start, CASE WHEN is_base THEN 1.0 ELSE score END AS score FROM merged m WHERE CASE WHEN is_base THEN is_full ELSE score >= {share}
  AND NOT EXISTS (SELECT 1 FROM merged o WHERE o.row = m.row AND o.phrase = m.phrase AND (o.start BETWEEN m.start - {slack} AND m.start - 1 AND o.score >= m.score OR o.start BETWEEN m.start + 1 AND m.start + {slack} AND o.score > m.score)) END),
found AS (SELECT row, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM spans GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN found USING (row)"""


ORACLE = _oracle()
