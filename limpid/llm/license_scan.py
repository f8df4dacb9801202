"""Operator 7: licence texts found by votes of word k-grams on offset diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from limpid.llm.columns import ascii_lower, documents, text_of

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 4

# Phrases and the labels they stand for.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Notices of widely used public licences, as their authors ask to have them quoted.
NOTICES = (
    ("mit-text",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files, to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software"),
    ("mit-text",
     "The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("mit-phrase", "Released under the MIT License"),
    ("mit-phrase", "This project is licensed under the MIT License"),
    ("apache-text",
     "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at"),
    ("apache-text",
     "Unless required by applicable law or agreed to in writing, software distributed under the "
     "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("apache-phrase", "Licensed under the Apache License, Version 2.0"),
    ("gpl-text",
     "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation"),
    ("gpl-text",
     "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
     "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-phrase", "under the terms of the GNU General Public License"),
    ("bsd-text",
     "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("cc-phrase", "This work is licensed under a Creative Commons Attribution"),
    ("all-rights-phrase", "All rights reserved. No part of this publication may be reproduced"),
)
DRIFT = 3  # words that may be added or lost between neighbouring diagonals
COVER = 0.6  # share of a notice's k-grams that a span must hold


def words_of(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, lower-cased."""
    parts = F.split(ascii_lower(text), BREAK)
    return F.filter(parts, lambda w: w != "")


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])


def template_grams(spark, notices=NOTICES, k: int = K) -> DataFrame:
    """A row per template position: template, label, t_pos, t_size, gram, h. As small as the list."""
    rows = [(n, label, text) for n, (label, text) in enumerate(notices)]
    t = spark.createDataFrame(rows, "template int, label string, text string")
    t = t.select("template", "label", words_of(F.col("text")).alias("w"))
    t = t.filter(F.size("w") >= k).withColumn("t_size", F.size("w") - (k - 1))
    t = t.select("template", "label", "t_size", "w", F.explode(F.sequence(F.lit(0), F.col("t_size") - 1)).alias("t_pos"))
    t = t.withColumn("gram", _gram(F.col("w"), F.col("t_pos"), k))
    return t.select("template", "label", "t_size", "t_pos", "gram", F.xxhash64("gram").alias("h"))


def _with_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_of()).alias("_text"), words_of(text_of()).alias("_words"))


def spans(docs: DataFrame, notices=NOTICES, k: int = K, drift: int = DRIFT, cover: float = COVER) -> DataFrame:
    """Verified spans: doc_id, label, template, start, end (words, end exclusive), score.

    Every k-gram of every document is hashed and joined to the template positions; the hash
    finds, the coverage of a span decides. Votes are added up per document, template and diagonal (place
    minus template position) before anything is shuffled by document. Diagonals at most
    `drift` apart are one span, as words were put in or left out. A span stands if it holds
    `cover` of the notice's k-grams, counted once each, within the length the notice and the
    drift allow. The joined side is the notice list: its size is known here, not that of the data.
    """
    grams = F.broadcast(template_grams(docs.sparkSession, notices, k).withColumnRenamed("gram", "t_gram"))
    d = _with_words(docs)
    size = F.size("_words")
    hashed = F.when(
        size >= k,
        F.transform(
            F.sequence(F.lit(0), size - k),
            lambda i: F.struct(i.alias("pos"), F.xxhash64(_gram(F.col("_words"), i, k)).alias("h")),
        ),
    )
    # An outer generator: for an inner one Spark puts a filter on the array below the projection
    # of the words, and the words would be split again for every k-gram.
    places = d.withColumn("_grams", hashed).select("doc_id", "_text", F.inline_outer("_grams"))
    votes = (
        places.join(grams, "h")
        .groupBy("doc_id", "_text", "template", "label", "t_size", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .agg(F.collect_set("t_pos").alias("held"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    )
    of_doc = W.partitionBy("doc_id", "_text", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(of_doc) > drift, F.lit(True)).cast("int")
    merged = (
        votes.withColumn("_new", new)
        .withColumn("_span", F.sum("_new").over(of_doc))
        .groupBy("doc_id", "_text", "template", "label", "t_size", "_span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n_held"),
            F.min("first").alias("start"), (F.max("last") + k).alias("end"),
            (F.max("diagonal") - F.min("diagonal")).alias("_drift"),
        )
    )
    score = F.col("n_held") / F.col("t_size")
    fits = F.col("end") - F.col("start") <= F.col("t_size") + (k - 1) + F.col("_drift")
    return merged.withColumn("score", score).filter((score >= cover) & fits).select(
        "doc_id", "_text", "label", "template", "start", "end", "score"
    )


def phrase_places(words: Column, phrase: str) -> Column:
    """Places where the phrase's words stand consecutively; scanned only where its text occurs."""
    parts = phrase.split(" ")

    def here(i):
        condition = F.get(words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            condition = condition & (F.get(words, i + j) == part)
        return condition

    enough = F.size(words) >= len(parts)
    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.when(enough & F.contains(F.array_join(words, " "), F.lit(phrase)), found).otherwise(
        F.array().cast("array<int>")
    )


def scanned(docs: DataFrame, **options) -> DataFrame:
    """A row per document: the phrase counts, and the labels of phrases and verified spans.

    Null text has no word. `score` is 1 where a phrase stands, else the best span's score,
    else 0. A row that occurs twice gets two equal rows.
    """
    d = _with_words(docs).withColumns(
        {f"_p{n}": phrase_places(F.col("_words"), phrase) for n, (phrase, _) in enumerate(PHRASES)}
    )
    places = F.flatten(F.array(*[F.col(f"_p{n}") for n in range(len(PHRASES))]))
    names = F.array_compact(
        F.array(*[F.when(F.size(f"_p{n}") > 0, F.lit(label)) for n, (_, label) in enumerate(PHRASES)])
    )
    d = d.select(
        "doc_id", "_text", F.size("_words").cast("long").alias("n_words"), places.alias("_places"),
        names.alias("_names"),
    )
    found = spans(docs, **options).groupBy("doc_id", "_text").agg(
        F.collect_set("label").alias("_labels"), F.max("score").alias("_score")
    )
    f = found.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), "_labels", "_score")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t"))
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.concat("_names", F.coalesce("_labels", none))))
    return d.join(f, same, "left").select(
        "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_names"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("_names") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark, folder):
    return scanned(documents(spark, folder))


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_NORMAL = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_GRAM_AT = " || ' ' || ".join(f"w[i + {j}]" for j in range(K))
_PLACES = " UNION ALL ".join(
    "SELECT doc_id, i - 1 AS p, '{}' AS label FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {})) AS i FROM d) WHERE {}".format(
        label, len(phrase.split()) - 1,
        " AND ".join(f"w[i + {j}] = '{part}'" for j, part in enumerate(phrase.split())),
    )
    for phrase, label in PHRASES
)
OP7_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_NORMAL.format("coalesce(text, '')")} AS w FROM documents),
base AS (SELECT doc_id, count(*) AS n, min(p) AS lo, max(p) AS hi, list(DISTINCT label) AS names FROM ({_PLACES}) GROUP BY doc_id),
t0 AS (SELECT unnest(generate_series(0, {len(NOTICES) - 1})) AS template,
              unnest([{_list(n[0] for n in NOTICES)}]) AS label, unnest([{_list(n[1] for n in NOTICES)}]) AS text),
t1 AS (SELECT template, label, {_NORMAL.format("text")} AS w FROM t0),
t AS (SELECT template, label, t_size, i - 1 AS t_pos, {_GRAM_AT} AS g
      FROM (SELECT *, len(w) - {K - 1} AS t_size, unnest(generate_series(1, len(w) - {K - 1})) AS i FROM t1)),
g AS (SELECT doc_id, i - 1 AS pos, {_GRAM_AT} AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {K - 1})) AS i FROM d)),
v AS (SELECT doc_id, template, label, t_size, pos, t_pos, pos - t_pos AS diagonal FROM g JOIN t USING (g)),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {DRIFT} THEN 0 ELSE 1 END AS new FROM v
      WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS span FROM n),
m AS (SELECT doc_id, label, count(DISTINCT t_pos) / t_size AS score,
             max(pos) + {K} - min(pos) <= t_size + {K - 1} + max(diagonal) - min(diagonal) AS fits
      FROM s GROUP BY doc_id, template, label, t_size, span),
f AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM m WHERE score >= {COVER} AND fits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(names, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(names, []) || coalesce(labels, []))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(score, 0) END::DOUBLE AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id
"""
