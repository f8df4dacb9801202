"""Operator 9: a threshold table compiled into one projection of ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid.llm.columns import SPACES, documents, text_of, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with", "as",
    "de", "la", "le", "les", "des", "et", "que", "un", "une", "du", "pour", "qui", "dans",
    "el", "los", "las", "en", "por", "se", "con", "una", "y", "o", "del",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "im", "ist", "nicht", "ein", "eine",
)

# The table: a rule fails where 100 * left > percent * right. The first two are the base rules.
BASE_RULES = (
    ("too_short", "missing_words", 0, "n_words"),
    ("repeated_words", "n_repeat_words", 30, "n_words"),
)
RULES = (
    ("symbols", "n_symbols", 10, "n_words"),
    ("short_words", "n_words", 67, "word_chars"),
    ("long_words", "word_chars", 1500, "n_words"),
    ("few_stop_words", "n_words", 2500, "n_stop_words"),
    ("few_letters", "word_chars", 200, "n_letters"),
    ("repeated_lines", "n_dup_lines", 30, "n_lines"),
)
MIN_WORDS = 20


def failed(rule: tuple[str, str, int, str]) -> Column:
    _, left, percent, right = rule
    return 100 * F.col(left) > percent * F.col(right)


def any_failed(rules) -> Column:
    result = F.lit(False)
    for rule in rules:
        result = result | failed(rule)
    return result


def _count(condition, values: Column) -> Column:
    return F.size(F.filter(values, condition)).cast("long")


def _paired(step: int) -> Column:
    return F.transform("_hashes", lambda h, i: F.xxhash64(h, F.get("_hashes", i + step)))


def rated(docs: DataFrame, rules=RULES, base_rules=BASE_RULES) -> DataFrame:
    """Every document with its counts, the names of the rules it fails, and `kept`.

    Only `doc_id` and `text` are read, so other columns may have any name. A null or empty
    text has no word: every count is 0 and it fails `too_short`. A row that occurs twice is
    rated twice. Nothing is shuffled; each document is a row from the scan to the result.
    """
    d = docs.select("doc_id", text_of().alias("_text"))
    d = d.select("doc_id", "_text", words_of(F.col("_text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda l: F.length(F.btrim(l, F.lit(SPACES))) > 0)
    d = d.select(
        "doc_id", "_text", "_words", lines.alias("_lines"),
        F.size("_words").cast("long").alias("n_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    # Hashes of 2, 4, then 8 words, each from two of the level before.
    for step in (1, 2, 4):
        d = d.withColumn("_hashes", _paired(step))
    windows = F.when(
        F.col("n_words") >= WINDOW, F.slice("_hashes", 1, (F.col("n_words") - WINDOW + 1).cast("int"))
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.select(
        "doc_id", "n_words", windows.alias("_windows"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _count(lambda w: w.isin(*STOP_WORDS), F.col("_words")).alias("n_stop_words"),
        F.length(F.regexp_replace("_text", r"\P{L}+", "")).cast("long").alias("n_letters"),
    )
    # Windows by hash, then place: equal neighbours are repeats. Only texts with any are sorted.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("_placed", F.when(repeats, F.sort_array(placed))).drop("_windows")
    equal = lambda x, j: F.coalesce(F.get("_placed", j)["h"] == x["h"], F.lit(False))
    again = F.filter("_placed", lambda x, j: equal(x, j - 1) | equal(x, j + 1))
    d = d.withColumn("_starts", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_placed")
    covered = F.transform(
        "_starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - p, F.lit(WINDOW)))
    )
    d = d.withColumn(
        "n_repeat_words",
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"), F.lit(0).cast("long")),
    ).drop("_starts")
    d = d.withColumn("missing_words", F.greatest(MIN_WORDS - F.col("n_words"), F.lit(0)))
    names = F.array(*[F.when(failed(r), F.lit(r[0])) for r in (*base_rules, *rules)])
    d = d.withColumn("base_failed", any_failed(base_rules))
    return d.withColumns(
        {"kept": ~(F.col("base_failed") | any_failed(rules)), "failed_rules": F.array_compact(names)}
    )


DIGEST = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "kept",
)


def op9_quality_rules(spark, folder):
    return rated(documents(spark, folder)).select(*DIGEST)


def _sql_failed(rules) -> str:
    return " OR ".join(f"100 * {left} > {percent} * {right}" for _, left, percent, right in rules)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WS = r"[\x20\x09-\x0D]"
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '{_WS}+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_filter(ws, lambda x: x IN ({_STOP_SQL}))) AS n_stop_words,
         length(regexp_replace(t, '\PL+', '', 'g')) AS n_letters,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         greatest({MIN_WORDS} - len(ws), 0) AS missing_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_sql_failed(BASE_RULES)}) AS base_failed,
       NOT ({_sql_failed(BASE_RULES + RULES)}) AS kept
FROM m
"""
