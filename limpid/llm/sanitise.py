"""Operator 2: personal data found by pattern, and terms that disclose it by co-occurrence.

A protected entity is a value that a base pattern finds. A term near it (within `REACH`
characters) discloses it by their point-wise mutual information over documents,
log(N c / (df_e df_t)), as a share of the entity's own information, log(N / df_e). Where that
share passes a threshold the term is generalised, and above a higher one removed. A pair
counts only if it stands in two different contexts, so that exact copies prove nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid.llm.columns import documents, quoted, text_of
from limpid.storage import materialised

_LOCAL = r"[A-Za-z0-9._%+-]"
# A match starts where a run of its first class starts, or where the match before ended; loops
# that nothing after them could shorten are possessive. Both keep long runs linear.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = "term"
REACH = 120
SUPPORT = 2
GENERALISE_AT, REMOVE_AT = 0.7, 0.95
BROADCAST_TERMS = 200_000
WORD = r"[\p{L}\p{N}]{3,}+"
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def places(text: Column, pattern: str) -> Column:
    """start, end (code points) and value of each match: what lies between the matches has
    the lengths that add up to the places."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")
    )

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        hit = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("value"))
        more = F.struct(end.alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))
        return F.when(x["hit"].isNull(), acc).otherwise(more)

    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def part(c, i):
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    values = F.transform(F.reverse(F.split(digits, "")), part)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(small))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def maybe_personal(text: Column) -> Column:
    """No base pattern matches a text without a digit and without an at sign."""
    return text.rlike("[0-9@]")


def base_spans(text: Column) -> Column:
    """Valid matches of all kinds, by start, then kind as listed."""
    likely = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    parts = []
    for rank, kind in enumerate(KINDS):
        spans = F.transform(_kept(places(text, PATTERNS[kind]), kind), _as_span(rank, kind))
        parts.append(F.when(likely.get(kind, F.lit(True)), spans).otherwise(F.array().cast(f"array<{_SPAN}>")))
    every = F.array_sort(F.concat(*parts))
    return F.when(maybe_personal(text), every).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _kept(found: Column, kind: str) -> Column:
    return F.filter(found, lambda x: _valid(kind, x["value"]))


def _as_span(rank: int, kind: str):
    return lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
        F.lit(kind).alias("kind"), x["value"].alias("value"),
    )


def _near(text: Column, spans: Column, length: Column) -> Column:
    """For each span its entity, the digest of its context, and the whole words there."""

    def around(s):
        begin = F.greatest(s["start"] - REACH, F.lit(0))
        stop = F.least(s["end"] + REACH, length)
        left = F.substring(text, begin + 1, s["start"] - begin)
        right = F.substring(text, s["end"] + 1, stop - s["end"])

        def moved(offset):
            return lambda x: F.struct(
                (x["start"] + offset).alias("start"), (x["end"] + offset).alias("end"), F.lower(x["value"]).alias("term")
            )

        words = F.concat(
            F.transform(places(left, WORD), moved(begin)), F.transform(places(right, WORD), moved(s["end"]))
        )
        whole = F.filter(
            words,
            lambda w: ((w["start"] > begin) | (begin == 0)) & ((w["end"] < stop) | (stop == length))
            & ~F.exists(spans, lambda o: (w["start"] < o["end"]) & (o["start"] < w["end"])),
        )
        return F.struct(
            F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"),
            F.xxhash64(left, right).alias("context"), whole.alias("words"),
        )

    return F.transform(spans, around)


def found(docs: DataFrame) -> DataFrame:
    """Base spans of every document and what stands near them, written once."""
    d = docs.select("doc_id", text_of().alias("_t"))
    d = d.select("doc_id", "_t", F.xxhash64("_t").alias("_text"), base_spans(F.col("_t")).alias("spans"))
    near = F.when(F.size("spans") > 0, _near(F.col("_t"), F.col("spans"), F.length("_t")))
    return materialised(d.select("doc_id", "_text", "spans", near.alias("near")), "personal")


def disclosing(docs: DataFrame, personal: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(occurrences, shares): every word near an entity, and each pair's share of disclosure.

    `personal` may leave out documents without any span; counts are over all rows of `docs`.
    """
    one = personal.select("doc_id", "_text", F.explode_outer("near").alias("n")).filter("n is not null")
    occurrences = materialised(
        one.select("doc_id", "_text", "n.entity", "n.context", F.inline("n.words")), "near-words"
    )
    pairs = occurrences.groupBy("entity", "term", "context", "doc_id", "_text").count()
    pairs = pairs.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("c"), F.count("*").alias("contexts"))
    pairs = materialised(pairs.filter(F.col("contexts") >= support), "pairs")
    terms = materialised(pairs.select("term").distinct(), "terms")
    total = docs.count()
    words = F.array_distinct(F.split(F.lower(text_of()), r"[^\p{L}\p{N}]+"))
    every = docs.select(F.explode_outer(words).alias("term"))
    n_terms = terms.count()
    if n_terms == 0:
        df_t = terms.withColumn("df_t", F.lit(0).cast("long"))
    elif n_terms <= BROADCAST_TERMS:
        df_t = every.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df_t"))
    else:
        df_t = every.groupBy("term").agg(F.count("*").alias("df_t")).join(terms, "term", "left_semi")
    df_e = (
        occurrences.select("entity", "doc_id", "_text").distinct().groupBy("entity").agg(F.count("*").alias("df_e"))
    )
    own = F.log2(F.lit(float(total)) / F.col("df_e"))
    joint = F.log2(F.col("c") * F.lit(float(total)) / (F.col("df_e") * F.col("df_t")))
    share = F.when(own > 0, joint / own).otherwise(0.0)
    return occurrences, pairs.join(df_t, "term").join(df_e, "entity").select("entity", "term", share.alias("share"))


def term_spans(docs: DataFrame, personal: DataFrame, generalise_at: float = GENERALISE_AT, **options) -> DataFrame:
    """doc_id, _text, terms: the places whose term discloses an entity near it."""
    occurrences, shares = disclosing(docs, personal, **options)
    strong = shares.filter(F.col("share") >= generalise_at)
    places_of = (
        occurrences.join(strong, ["entity", "term"])
        .groupBy("doc_id", "_text", "start", "end").agg(F.max("share").alias("share"))
    )
    item = F.struct(
        "start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(TERM).alias("kind"),
        F.round("share", 6).cast("string").alias("value"),
    )
    return places_of.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_list(item)).alias("terms"))


def _joined(spans: Column) -> Column:
    line = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(line, ",")


def _with_terms(left: DataFrame, terms: DataFrame) -> DataFrame:
    t = terms.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_tt"), "terms")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_tt"))
    none = F.array().cast(f"array<{_SPAN}>")
    return left.join(t, same, "left").withColumn("terms", F.coalesce("terms", none)).drop("_id", "_tt")


def op2_sanitise(spark, folder):
    """A row per document. Null text is empty: no span. Rows that occur twice get equal rows."""
    docs = documents(spark, folder).select("doc_id", "text")
    personal = found(docs)
    d = _with_terms(personal.drop("near"), term_spans(docs, personal))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return d.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.encode(_joined(F.col("spans")), "UTF-8"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("spans", "terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def rewritten(text: Column, spans: Column, remove_at: float = REMOVE_AT) -> Column:
    """The text with each span replaced by its kind in brackets. A generalised term keeps only
    what sort of word it is; a removed one goes. Spans that overlap are replaced as one."""

    def label(s):
        is_term = s["kind"] == TERM
        removed = is_term & (s["value"].cast("double") >= remove_at)
        return F.when(removed, "").when(is_term, "[WORD]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def step(acc, s):
        at = acc["at"]
        gap = F.when(s["start"] > at, F.substring(text, at + 1, s["start"] - at)).otherwise("")
        new = F.when(s["start"] >= at, label(s)).otherwise("")
        more = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, new)).alias("out"))
        return F.when(s["end"] <= at, acc).otherwise(more)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(spans, start, step, rest)


def sanitised(docs: DataFrame, remove_at: float = REMOVE_AT, **options) -> DataFrame:
    """The documents with personal data and disclosing terms taken out of `text`.

    All columns stay; n_chars, where there is one, follows the new text. A text without a digit
    and without an at sign is passed on as it is (null stays null) and never shuffled.
    """
    columns = docs.columns
    likely = F.coalesce(maybe_personal(F.col("text")), F.lit(False))
    some = docs.filter(likely)
    personal = found(some)
    terms = materialised(term_spans(docs, personal, **options), "term-spans")
    key = F.xxhash64(text_of())
    keyed = some.select(F.struct(*quoted(columns)).alias("_row"), "doc_id", "text", key.alias("_text"))
    joined = _with_terms(keyed, terms).withColumn("_spans", base_spans(F.col("text")))
    every = F.array_sort(F.concat("_spans", "terms"))
    new = joined.withColumn("_new", F.when(F.size(every) > 0, rewritten(F.col("text"), every, remove_at)).otherwise(F.col("text")))
    values = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    changed = new.select(*[values.get(c, F.col("_row").getField(c)).alias(c) for c in columns])
    return docs.filter(~likely).select(*quoted(columns)).unionByName(changed)

