"""License scans by diagonal voting, in DataFrame functions only.

Every text's rolling word k-grams are joined to the positions of the same k-grams in license templates.
A match at text word p and template word q votes for the diagonal p - q. A short phrase stands at each
diagonal on which all of its k-grams vote. For long templates neighbouring diagonals are merged, so inserted
or lost words don't break a span, and the span is verified by the template words that its votes cover.
The join compares hashes first and then the k-grams' words themselves, so every vote is verified.

Defined results: null or empty texts have no words, places or labels, and score 0; rows that repeat a
doc_id with the same text get the same result, and with another text their own; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same words before A-Z are lower-cased, for counting alone.
ANY_CASE_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
GRAM = 3
#: Phrases that must stand whole: (label, phrase).
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Texts of which a part may stand: (label, words of a public license's grant or notice).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Share of a template's words that a span must cover, and how far apart merged diagonals may lie.
COVERED, NEIGHBOUR = 0.6, 4
#: Templates are parameters of the driver's program; this bounds what is broadcast.
MOST_TEMPLATE_WORDS = 200_000


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """template, label, phrase (boolean), n_words, q, gram, h: one row for each k-gram of each template."""
    rows = []
    for number, (label, text, whole) in enumerate([(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in templates]):
        w = text.split()
        if len(w) < k:
            raise ValueError(f"a template needs {k} words: {text}")
        rows += [(number, label, whole, len(w), q, " ".join(w[q : q + k])) for q in range(len(w) - k + 1)]
    if len(rows) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have over {MOST_TEMPLATE_WORDS} words")
    grams = spark.createDataFrame(rows, "template int, label string, phrase boolean, n_words int, q int, gram string")
    return grams.withColumn("h", F.xxhash64("gram"))


def votes(docs: DataFrame, grams: DataFrame, k: int = GRAM) -> DataFrame:
    """doc_id, key, template, label, phrase, t_words, q, diagonal: each place of a template's k-gram."""
    listed = docs.select("doc_id", text_key().alias("key"), words(F.col("text")).alias("w"))
    rolled = listed.select(
        "doc_id", "key", F.posexplode(F.transform("w", lambda w, i: F.concat_ws(" ", w, *[F.get("w", i + j) for j in range(1, k)]))).alias("p", "gram")
    ).withColumn("h", F.xxhash64("gram"))
    t = grams.select(*[F.col(c).alias(f"t_{c}") for c in grams.columns])
    joined = rolled.join(F.broadcast(t), (F.col("h") == F.col("t_h")) & (F.col("gram") == F.col("t_gram")))
    return joined.select(
        "doc_id", "key", F.col("t_template").alias("template"), F.col("t_label").alias("label"), F.col("t_phrase").alias("phrase"),
        F.col("t_n_words").alias("t_words"), F.col("t_q").alias("q"), (F.col("p") - F.col("t_q")).alias("diagonal"),
    )


def license_scan(
    docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, k: int = GRAM, covered: float = COVERED, neighbour: int = NEIGHBOUR
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document.

    ``score`` is the largest share of one template's words found in one span, 1 for a whole phrase.
    """
    grams = template_grams(docs.sparkSession, phrases, templates, k)
    by = ["doc_id", "key", "template", "label", "phrase", "t_words"]
    # A diagonal holds at most the template's k-grams, so the sets below are bounded by the template.
    diagonals = votes(docs, grams, k).groupBy(*by, "diagonal").agg(F.collect_set("q").alias("qs"))

    # Diagonals of one text and template in order; a phrase's stay apart, a template's merge with neighbours.
    order = Window.partitionBy(*by).orderBy("diagonal")
    apart = F.when(F.col("phrase"), 0).otherwise(neighbour)
    spans = (
        diagonals.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > apart).cast("int"))
        .withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(order))
        .groupBy(*by, "span")
        .agg(F.min("diagonal").alias("place"), F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
        .withColumn("covers", F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + (k - 1)))))))
        .withColumn("share", F.col("covers") / F.col("t_words"))
    )
    whole = F.col("phrase") & (F.size("qs") == F.col("t_words") - (k - 1))
    part = ~F.col("phrase") & (F.col("share") >= covered)
    found = spans.groupBy("doc_id", "key").agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("place"))).alias("first_word"),
        F.max(F.when(whole, F.col("place"))).alias("last_word"),
        F.collect_set(F.when(whole, F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(part, F.col("label"))).alias("method_labels"),
        F.max(F.when(whole | ~F.col("phrase"), F.col("share"))).alias("score"),
    )
    none = F.array().cast("array<string>")
    rows = docs.select(
        F.col("doc_id").alias("d_id"), text_key().alias("d_key"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"),
    )
    named = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in c]))), ",")
    return rows.join(found, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_key") == F.col("key")), "left").select(
        F.col("d_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        named("base_labels").alias("base_labels"),
        named("base_labels", "method_labels").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle(phrases=PHRASES, templates=TEMPLATES, k: int = GRAM) -> str:
    """DuckDB SQL for the rows of ``license_scan`` over ``documents``: base places by whole phrases, labels by spans."""
    longest = max(k, *(len(p.split()) for _, p in phrases))
    gram = lambda n: " || ' ' || ".join(["word", *(f"lead(word, {j}) OVER o" for j in range(1, n))])
    grams = ", ".join(f"{gram(n)} AS g{n}" for n in range(2, longest + 1))
    bases = " UNION ALL ".join(f"SELECT rid, p, '{label}' AS label FROM l WHERE g{len(p.split())} = '{p}'" for label, p in phrases)
    rows = [(t, label, x.split()) for t, (label, x) in enumerate(templates)]
    values = ", ".join(f"({t}, '{label}', {len(w)}, {q}, '{' '.join(w[q : q + k])}')" for t, label, w in rows for q in range(len(w) - k + 1))
    parts = ", ".join(f"(q + {j})" for j in range(k))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
l AS (SELECT rid, p, {grams} FROM x WINDOW o AS (PARTITION BY rid ORDER BY p)),
b AS ({bases}),
base AS (SELECT rid, count(*) AS n, min(p) AS low, max(p) AS high, list(DISTINCT label) AS names FROM b GROUP BY rid),
t(template, label, t_words, q, gram) AS (VALUES {values}),
v AS (SELECT DISTINCT l.rid, template, label, t_words, q, p - q AS diagonal FROM l JOIN t ON l.g{k} = t.gram),
n AS (SELECT *, diagonal - lag(diagonal) OVER o > {NEIGHBOUR} AS new FROM v WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal, q)),
s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY rid, template ORDER BY diagonal, q ROWS UNBOUNDED PRECEDING) AS span FROM n),
c AS (SELECT DISTINCT rid, template, label, t_words, span, unnest([{parts}]) AS word FROM s),
h AS (SELECT rid, label, count(*) / t_words AS share FROM c GROUP BY rid, template, label, t_words, span),
m AS (SELECT rid, max(share) AS share, coalesce(list(DISTINCT label) FILTER (WHERE share >= {COVERED}), []) AS names FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, low AS first_word, high AS last_word,
       array_to_string(list_sort(coalesce(base.names, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.names, []), coalesce(m.names, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN m USING (rid)
"""


ORACLE = oracle()
