"""Licence scan by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii

#: Phrases of the contract and opening words of widely used notices.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
}
NOTICE_K = 4
#: Diagonals this far apart belong to one notice: so many words may be missing or put in.
SLACK = 3
#: Share of a notice's k-grams that verifies a span.
COVERAGE = 0.7
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[int, str, bool, int, int, int, list[str]]]:
    """(template, label, is_phrase, k, grams of the template, position, words of the gram); at most 62 grams a template."""
    rows = []
    for t, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        phrase = t < len(PHRASES)
        words, k = text.split(), 2 if phrase else NOTICE_K
        grams = len(words) - k + 1
        assert grams <= 62
        rows += [(t, label, phrase, k, grams, i, words[i:i + k]) for i in range(grams)]
    return rows


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence evidence of every document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every position of every document yields the hashes of the word 2-gram and 4-gram that start there. They join the
    hashed grams of the templates (a fixed table of a few hundred rows, broadcast; the gram's words are compared too,
    so a colliding hash gives nothing), and hits vote for their diagonal, the offset of document to template. Votes
    are counted before the shuffle as a bit set of the template's grams. Neighbouring diagonals of a notice merge
    (words may be lost or inserted); a span is verified by the share of its template's grams it holds: all of them for
    a phrase, COVERAGE for a notice within half as much room again. Only hits and one row a document are shuffled.

    ``score`` is the best such share (0 without any hit). Null or empty text gives zero words, null positions and empty labels.
    Rows that repeat id and text are scanned once and give as many rows; rows that repeat an id with another text are
    documents of their own. Other columns are not read. No rows give no rows.
    """
    spark: SparkSession = docs.sparkSession
    grams = spark.createDataFrame(templates(), "template int, label string, phrase boolean, k int, grams int, at int, gram array<string>")
    code = lambda k, words: F.xxhash64(F.lit(k), *words)
    part = lambda c, k: [F.get(c, F.lit(i)) for i in range(k)]
    grams = grams.withColumn("hash", F.when(F.col("k") == 2, code(2, part(F.col("gram"), 2))).otherwise(code(NOTICE_K, part(F.col("gram"), NOTICE_K))))
    header = spark.createDataFrame([(-1, "", False, 0, 1, 0, [], 0)], grams.schema)
    grams = F.broadcast(grams.unionByName(header))

    text = lower_ascii(F.coalesce(text_col, F.lit("")))
    key = [F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text")]
    rows = docs.select(*key, F.array_remove(F.split(text, _SEPARATOR), "").alias("words"))
    rows = rows.select("_id", "_text", F.size("words").cast("long").alias("n_words"), "words", F.posexplode_outer("words").alias("pos", "w0"))
    at = lambda i: F.get("words", F.col("pos") + i)
    # one header row a document keeps those without a hit
    starts = F.array(
        F.when(F.coalesce("pos", F.lit(0)) == 0, F.lit(0).cast("long")),
        F.when(F.col("pos") + 2 <= F.col("n_words"), code(2, [F.col("w0"), at(1)])),
        F.when(F.col("pos") + NOTICE_K <= F.col("n_words"), code(NOTICE_K, [F.col("w0"), *(at(i) for i in range(1, NOTICE_K))])),
    )
    rows = rows.select("_id", "_text", "n_words", "words", "pos", "w0", F.explode(starts).alias("hash"))
    same = (F.col("w0") == F.get("gram", F.lit(0))) & (at(1) == F.get("gram", F.lit(1)))
    for i in range(2, NOTICE_K):
        same = same & ((F.col("k") <= i) | (at(i) == F.get("gram", F.lit(i))))
    hits = rows.join(grams, (rows["hash"] == grams["hash"]) & ((F.col("k") == 0) | same)).select(
        "_id", "_text", "n_words", "template", "label", "phrase", "k", "grams", "at", F.coalesce("pos", F.lit(0)).alias("pos"),
    )
    by = ["_id", "_text", "n_words", "template", "label", "phrase", "k", "grams"]
    votes = hits.groupBy(*by, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("hits"),
    )
    along = Window.partitionBy("_id", "_text", "n_words", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("phrase"), 0).otherwise(SLACK)
    votes = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(along))
    spans = votes.groupBy(*by, "span").agg(F.bit_or("mask").alias("mask"), F.min("lo").alias("lo"), (F.max("hi") + F.col("k")).alias("end"), F.max("hits").alias("hits"))
    share = F.bit_count("mask") / F.col("grams")
    room = F.col("end") - F.col("lo") <= 1.5 * (F.col("grams") + F.col("k") - 1)
    real = F.col("template") >= 0
    spans = spans.withColumn("share", F.when(real, share).otherwise(0.0)).withColumn("ok", real & F.when(F.col("phrase"), share == 1).otherwise((share >= COVERAGE) & room))
    base = F.col("ok") & F.col("phrase")
    labels = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(F.when(c, F.col("label")))))
    return spans.groupBy("_id", "_text", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("ok")).alias("labels"), F.max("share").alias("score"),
        F.max(F.when(~real, F.col("hits"))).cast("int").alias("rows"),  # header rows: one for each row that repeats id and text
    ).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle_sql() -> str:
    """The scan in DuckDB SQL over the table ``documents``; grams are compared as words, without hashes."""
    values = ",\n".join(
        "({}, '{}', {}, {}, {}, {}, '{}')".format(t, label, str(phrase).lower(), k, n, at, " ".join(g)) for t, label, phrase, k, n, at, g in templates()
    )
    word = "[^" + _SEPARATOR[1:-2] + "]+"
    gram = "array_to_string(words[p + 1:p + {k}], ' ')"
    return f"""
WITH grams(template, label, phrase, k, grams, place, gram) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(len(words))) AS p FROM d),
g AS (SELECT doc_id, p, 2 AS k, {gram.format(k=2)} AS gram FROM p WHERE p + 2 <= len(words)
      UNION ALL SELECT doc_id, p, {NOTICE_K}, {gram.format(k=NOTICE_K)} FROM p WHERE p + {NOTICE_K} <= len(words)),
v AS (SELECT doc_id, template, label, phrase, k, grams, p - place AS diagonal, bit_or(1::BIGINT << place) AS mask, min(p) AS lo, max(p) AS hi
      FROM g JOIN grams USING (k, gram) GROUP BY ALL),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= CASE WHEN phrase THEN 0 ELSE {SLACK} END THEN 0 ELSE 1 END AS new FROM v
      WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM n),
m AS (SELECT doc_id, template, label, phrase, k, grams, span, bit_or(mask) AS mask, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY ALL),
r AS (SELECT *, bit_count(mask) / grams AS share, hi + k AS stop FROM m),
o AS (SELECT *, CASE WHEN phrase THEN share = 1 ELSE share >= {COVERAGE} AND stop - lo <= 1.5 * (grams + k - 1) END AS ok FROM r)
SELECT d.doc_id, len(words)::BIGINT AS n_words, count(*) FILTER (ok AND phrase) AS n_base,
  min(lo) FILTER (ok AND phrase) AS first_word, max(lo) FILTER (ok AND phrase) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (ok AND phrase)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (ok)), ','), '') AS labels, coalesce(max(share), 0.0) AS score
FROM d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id, words
"""
