"""The same results as plain SQL over the given tables, for side-by-side checks."""

from __future__ import annotations

from limpid.catalog.dirty_orders import COLUMNS, DIRTY_ORDERS_SQL, TEXTS

D = f"WITH {DIRTY_ORDERS_SQL} "
_OTHERS = [c for c in COLUMNS if c not in TEXTS]
_CODE = r"'^[+-]?0\d[\d\s]*$'"
_GRADE = r"'^([+-]?\d+(?:[.,]\d+)?)\s*/\s*(\d+(?:[.,]\d+)?)$'"
_NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
_LOOK = (
    r"'^([0-9+\-.,;€$£ ]*|[+-]?\d+([.,]\d+)?\s*%|[+-]?\d+([.,]\d+)?\s*/\s*\d+([.,]\d+)?)$'"
)


def _union(parts) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def _amount(c: str) -> str:
    t = f"replace(regexp_replace(trim({c}), '[€$£ ]', '', 'g'), ',', '.')"
    return f"CASE WHEN regexp_full_match({t}, {_NUMBER}) THEN TRY_CAST({t} AS DOUBLE) END"


def _number(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), {_NUMBER}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def _grade(c: str, scale: int) -> str:
    num, den = (f"CAST(regexp_extract({c}, {_GRADE}, {g}) AS DOUBLE)" for g in (1, 2))
    return (
        f"CASE WHEN regexp_full_match({c}, {_GRADE}) THEN CASE WHEN {den} IN (0, {scale}) THEN {num} "
        f"ELSE round({num} / {den} * {scale}, 6) END END"
    )


def _graded(c: str, scale: int) -> str:
    return f"coalesce({_grade(c, scale)}, {_number(c)})"


_PERCENT = r"TRY_CAST(replace(regexp_extract(rate_txt, '^([+-]?\d+([.,]\d+)?)\s*%$', 1), ',', '.') AS DOUBLE)"


def _date(bounded: bool = True) -> str:
    shapes = (
        (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"),
        (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"),
        (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"),
        (r"\d{1,2}/\d{1,2}/\d{2}", "%d/%m/%y"),
    )
    cases = " ".join(
        f"WHEN regexp_full_match(date_txt, '{p}') THEN try_strptime(date_txt, '{f}')" for p, f in shapes
    )
    t = f"(CASE {cases} END)"
    return f"CASE WHEN year({t}) BETWEEN 1900 AND 2100 THEN {t} END" if bounded else t


_SQUEEZED_CITY = r"regexp_replace(trim(city), '\s+', ' ', 'g')"
_NULLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in COLUMNS)
_ROWS = f"rows_ AS (SELECT id, round(({_NULLS}) / {len(COLUMNS)}.0 * 100, 2) AS pct FROM d)"


def _first(c: str, n: int, test: str) -> str:
    return f"(SELECT {test} FROM (SELECT {c} AS v FROM d WHERE {c} IS NOT NULL ORDER BY id LIMIT {n}))"


def _candidate(c: str) -> str:
    codes = f"(SELECT count(*) FROM d WHERE regexp_matches(trim({c}), {_CODE}))"
    return (
        f"SELECT '{c}' AS \"column\" WHERE {codes} = 0 AND "
        + _first(c, 100, f"coalesce(bool_and(regexp_full_match(trim(v), {_LOOK})), false)")
    )


def _quartiles(t: str, c: str) -> str:
    return f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"


def _numeric(t: str) -> list[str]:
    return {
        "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
        "events": ["event_id", "user_id", "value"],
        "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax"],
        "d": ["id", "whole_gap", "price_out"],
    }[t]


def _fence(t: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count(*) AS n_outliers, "
        "round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS lower_bound, "
        "round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS upper_bound "
        f"FROM {t}, {_quartiles(t, c)} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) "
        "HAVING count(*) > 0"
    )


def _bounds(t: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", round(q1 - 1.5 * (q3 - q1), 6) AS low, "
        f"round(q3 + 1.5 * (q3 - q1), 6) AS high FROM {_quartiles(t, c)} WHERE q1 <> q3"
    )


def _describe(t: str, c: str) -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), 4) AS {n}" for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, {q}, "
        f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM {t}"
    )


def _categorical(t: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count(DISTINCT v) AS cardinality_absolute, "
        "round(count(DISTINCT v) / count(*) * 100, 2) AS cardinality_relative, "
        "round(count(v) / count(*) * 100, 2) AS sparsity_ratio, "
        "round(coalesce(max(n) / nullif(count(v), 0), 0) * 100, 2) AS skewness_frequency, "
        "coalesce(round(max(n) / nullif(count(v), 0) * 100, 2) > 90, false) AS is_high_skewness "
        f"FROM (SELECT {c} AS v, CASE WHEN {c} IS NOT NULL THEN count(*) OVER (PARTITION BY {c}) END AS n FROM {t})"
    )


def _box(t: str, c: str) -> str:
    lo, hi = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    return (
        f"SELECT '{c}' AS \"column\", round(any_value(q1), 6) AS q25, "
        f"round((SELECT quantile_cont({c}, 0.5) FROM {t}), 6) AS q50, round(any_value(q3), 6) AS q75, "
        f"round(any_value({lo}), 6) AS lower_fence, round(any_value({hi}), 6) AS upper_fence, "
        f"round(CAST(min({c}) FILTER ({c} BETWEEN {lo} AND {hi}) AS DOUBLE), 6) AS whisker_low, "
        f"round(CAST(max({c}) FILTER ({c} BETWEEN {lo} AND {hi}) AS DOUBLE), 6) AS whisker_high, "
        f"count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS n_fliers FROM {t}, {_quartiles(t, c)}"
    )


def _identifier(t: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS n_present, count(DISTINCT {c}) AS n_distinct, "
        f"count({c}) >= 20 AND count(DISTINCT {c}) / nullif(count({c}), 0) >= 0.9 AS is_identifier FROM {t}"
    )


def _anomaly(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", bool_or(edge) OR (bool_or(mixed) AND max(n) > 1) AS space_anomaly, "
        "bool_or(mixed) AND max(n) > 1 AS case_anomaly FROM (SELECT v <> trim(v) AS edge, "
        "v <> lower(v) AND v <> upper(v) AS mixed, count(*) OVER (PARTITION BY lower(v)) AS n "
        f"FROM (SELECT {c} AS v FROM d WHERE {c} IS NOT NULL))"
    )


def _mode(t: str, c: str) -> str:
    return f"(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _median(t: str, c: str) -> str:
    return f"(SELECT quantile_cont({c}, 0.5) FROM {t})"


# The whole run on the dirty view: typed columns, unique rows, fills, clips.
TYPED = f"""typed AS (
  SELECT id, ref, {_amount('amount_txt')} AS amount_txt, amount_early, {_date()} AS date_txt,
    CAST({_graded('note_txt', 5)} AS BIGINT) AS note_txt,
    CAST({_graded('note20_txt', 20)} AS BIGINT) AS note20_txt,
    {_PERCENT} AS rate_txt, lower({_SQUEEZED_CITY}) AS city, phone,
    CAST(whole_gap AS BIGINT) AS whole_gap, prio_gap, price_out
  FROM d)"""
_MEDIANS = ("amount_txt", "note_txt", "whole_gap", "price_out")
_FILLED = ", ".join(f"coalesce({c}, {_median('uniq', c)}) AS {c}" for c in _MEDIANS)
_FILLED += ", " + ", ".join(f"coalesce({c}, {_mode('uniq', c)}) AS {c}" for c in ("date_txt", "prio_gap"))
RUN = f"""{D}, {TYPED}, uniq AS (SELECT DISTINCT * FROM typed),
filled AS (SELECT * REPLACE ({_FILLED}) FROM uniq),
fence AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM {_quartiles('filled', 'price_out')}),
outside AS (SELECT count(*) AS n FROM filled, fence WHERE price_out < lo OR price_out > hi) """

_FILL_COUNTS = {c: f"(SELECT count(*) FROM uniq WHERE {c} IS NULL)" for c in (*_MEDIANS, "date_txt", "prio_gap")}
_N_DUPLICATES = "(SELECT count(*) FROM d) - (SELECT count(*) FROM uniq)"
_N_SPACES = f"(SELECT count(*) FROM d WHERE city <> {_SQUEEZED_CITY})"
_N_CASE = f"(SELECT count(*) FROM d WHERE {_SQUEEZED_CITY} <> lower({_SQUEEZED_CITY}))"
_N_LOST = {c: f"(SELECT count(*) FROM typed WHERE {c} IS NULL)" for c in ("amount_txt", "date_txt")}
_N_RESCALED = "(SELECT count(*) FROM d WHERE note20_txt = '4/5')"

# (step, column, metric, value, detail, examples) of the full run.
_AUDIT = [
    ("empty_cols_dropped", "mostly_null", "columns", "1", None, ""),
    ("whitespace_cleaned", "city", "values", _N_SPACES, None, ""),
    ("case_normalized", "city", "values", _N_CASE, None, ""),
    ("types_fixed", "whole_gap", "columns", "1", "double -> bigint", ""),
    ("types_converted", "amount_txt", "columns", "1", "string -> double", ""),
    ("types_converted", "date_txt", "columns", "1", "string -> timestamp_ntz", ""),
    ("types_converted", "note_txt", "columns", "1", "string -> bigint", ""),
    ("types_converted", "note20_txt", "columns", "1", "string -> bigint", ""),
    ("types_converted", "rate_txt", "columns", "1", "string -> double", ""),
    ("values_unparsed", "amount_txt", "values", _N_LOST["amount_txt"], None, "trop flou"),
    ("values_unparsed", "date_txt", "values", _N_LOST["date_txt"], None, "0197-08-14"),
    ("grades_rescaled", "note20_txt", "values", _N_RESCALED, "scale 20", "4/5 → 16"),
    ("duplicates_removed", None, "rows", _N_DUPLICATES, None, ""),
    *[("missing_filled", c, "values", _FILL_COUNTS[c], "fill_median", "") for c in _MEDIANS],
    *[("missing_filled", c, "values", _FILL_COUNTS[c], "fill_mode", "") for c in ("date_txt", "prio_gap")],
    ("outliers_corrected", "price_out", "values", "(SELECT n FROM outside)", "threshold 1.5", ""),
]


def _text(v: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"


def _audit_sql() -> str:
    return RUN + _union(
        f"SELECT '{s}' AS step, {_text(c)} AS \"column\", '{m}' AS metric, CAST({v} AS DOUBLE) AS value, "
        f"{_text(d)} AS detail, '{e}' AS examples"
        for s, c, m, v, d, e in _AUDIT
    )


def _totals(consent: bool) -> list[tuple[str, str, str]]:
    total = lambda step: " + ".join(v for s, _, _, v, _, _ in _AUDIT if s == step)
    columns = {"empty_cols_dropped": 1, "case_normalized": 1, "types_fixed": 1, "types_converted": 5}
    out = [(s, "columns", str(n)) for s, n in columns.items()]
    out += [(s, "values", total(s)) for s in ("whitespace_cleaned", "values_unparsed", "grades_rescaled")]
    out += [("duplicates_removed", "rows", total("duplicates_removed"))]
    out += [(s, "values", total(s) if consent else "0") for s in ("missing_filled", "outliers_corrected")]
    return out


def _step_totals(consent: bool, ignored: bool) -> str:
    flag = lambda s: (
        f", {str(not consent and s in ('missing_filled', 'outliers_corrected')).lower()} AS ignored"
        if ignored else ""
    )
    return RUN + _union(
        f"SELECT '{s}' AS step, '{u}' AS unit, CAST({v} AS BIGINT) AS total{flag(s)}"
        for s, u, v in _totals(consent)
    )


_TYPES_BEFORE = {c: "string" for c in TEXTS} | {"id": "bigint", "whole_gap": "double", "price_out": "double"}
_TYPES_AFTER = {
    c: t for c, t in _TYPES_BEFORE.items() if c != "mostly_null"
} | {"amount_txt": "double", "date_txt": "timestamp_ntz", "note_txt": "bigint", "note20_txt": "bigint",
     "rate_txt": "double", "whole_gap": "bigint"}


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "CAST(NULL AS VARCHAR)" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def _density() -> str:
    return """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) AS sd FROM events),
p AS (SELECT lo, (hi - lo) / 199 AS step, n, sd * power(n, -0.2) AS h FROM s),
g AS (SELECT lo + i * step AS x, n, h FROM p, range(200) AS r(i))
SELECT round(x, 6) AS x, round(sum(exp(-0.5 * power((x - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM g, events WHERE value IS NOT NULL GROUP BY x"""


def _corr(cols: list[str]) -> str:
    return _union(
        f"SELECT '{a}' AS column_x, '{b}' AS column_y, "
        + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)") + " AS correlation FROM lineitem"
        + (" LIMIT 1" if a == b else "")
        for a in cols for b in cols
    )


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_parquet"] = "SELECT * FROM orders"
    q["scan_csv"] = "SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size) FROM part"
    q["detect_dialect"] = """SELECT encoding, separator, count(*) AS n_lines FROM customer,
(SELECT unnest([';', ',', chr(9), '|']) AS separator), (SELECT unnest(['UTF-8', 'ISO-8859-1']) AS encoding) GROUP BY ALL"""
    q["scan_csv_losses"] = """SELECT 'further fields' AS kind, 'more' || c_custkey AS text FROM customer
WHERE c_custkey % 7 = 0 UNION ALL SELECT 'rows read', count(*)::VARCHAR FROM customer"""
    q["scan_csv_ragged"] = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'more' END AS over FROM customer"
    q["scan_csv_mixed_headers"] = "SELECT c_custkey, c_name, c_acctbal FROM customer"
    q["scan_csv_quoted_breaks"] = "SELECT c_custkey, c_name || chr(10) || c_mktsegment AS note FROM customer"
    q["scan_csv_late_bytes"] = "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN c_name || ' né' ELSE c_name END AS c_name FROM customer"
    q["scan_json_mixed_object"] = "SELECT c_custkey // 500 AS batch, c_custkey, c_name FROM customer"
    q["scan_jsonl_count"] = "SELECT count(*) FILTER (c_custkey % 50 <> 0) AS n_rows, count(*) FILTER (c_custkey % 50 = 0) AS n_bad FROM customer"
    q["nested_to_json"] = """SELECT r_regionkey, to_json(list({'key': n_nationkey, 'name': n_name} ORDER BY n_nationkey)) AS nations,
  to_json(list(n_nationkey ORDER BY n_nationkey)) AS keys, to_json(MAP {r_name: r_regionkey}) AS named, to_json({'a': r_name, 'b': NULL::INT}) AS pair
FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name"""
    q["sniff_format"] = """SELECT 'lines' AS source, 'json' AS format, count(*) AS n_rows FROM customer
UNION ALL SELECT 'tables', 'parquet', count(*) FROM orders"""
    q["read_protect_codes"] = D + "SELECT id, phone, whole_gap, price_out FROM d"
    q["infer_schema"] = _values(
        [(c, _TYPES_BEFORE[c]) for c in COLUMNS], '"column", type'
    )
    q["scan_excel_dir"] = "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer"
    q["scan_json"] = q["json_columnar_to_rows"] = "SELECT c_custkey, c_name, c_acctbal FROM customer"
    q["scan_jsonl_skip_corrupt"] = q["scan_json"] + " WHERE c_custkey % 50 <> 0"
    q["corrupt_json_lines"] = "SELECT count(*) AS n_corrupt FROM customer WHERE c_custkey % 50 = 0"
    q["sink_csv_roundtrip"] = q["scan_excel_dir"]

    q["drop_empty_columns"] = D + "SELECT * EXCLUDE (mostly_null) FROM d"
    q["select_numeric_columns"] = "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"
    markers = "('', 'nan', 'none', 'null', 'na', 'n/a', '-', '--')"
    q["significant_values"] = D + _union(
        f"SELECT '{c}' AS \"column\", count(*) AS n_significant FROM d "
        f"WHERE {c} IS NOT NULL AND lower(trim({c})) NOT IN {markers}" for c in TEXTS
    )
    q["problem_rows"] = (
        f"{D}, {_ROWS} SELECT id, pct AS null_pct, CASE WHEN pct > 90 THEN 'full_empty' ELSE "
        "'partially_empty' END AS kind FROM rows_ WHERE pct >= 30"
    )
    lo, hi = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    q["outlier_rows"] = (
        D + f"SELECT id, price_out FROM d, {_quartiles('d', 'price_out')} WHERE price_out < {lo} OR price_out > {hi}"
    )
    q["preview"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10"
    q["complete_cases"] = (
        D + "SELECT id, whole_gap, price_out FROM d WHERE id IS NOT NULL AND whole_gap IS NOT NULL AND price_out IS NOT NULL"
    )

    q["clean_whitespace"] = D + f"SELECT * REPLACE ({_SQUEEZED_CITY} AS city) FROM d"
    q["leading_zero_columns"] = D + _union(
        f"SELECT '{c}' AS \"column\", coalesce(bool_or(regexp_matches(trim({c}), {_CODE})), false) AS has_codes FROM d"
        for c in TEXTS
    )
    q["parse_grades"] = D + f"SELECT id, {_grade('note_txt', 5)} AS note_txt, {_grade('note20_txt', 20)} AS note20_txt FROM d"
    q["parse_percent"] = D + f"SELECT id, {_PERCENT} AS rate_txt FROM d"
    q["parse_amount"] = D + f"SELECT id, {_amount('amount_txt')} AS amount_txt, {_amount('amount_early')} AS amount_early FROM d"
    q["try_numeric"] = D + f"SELECT id, {_number('note_txt')} AS note_txt, {_number('phone')} AS phone FROM d"
    q["parse_mixed_dates"] = D + f"SELECT id, {_date()} AS date_txt FROM d"
    q["normalize_case"] = D + "SELECT id, ref, lower(city) AS city, prio_gap FROM d"
    q["identifier_like_columns"] = D + _union(
        f"SELECT '{c}' AS \"column\", " + _first(
            c, 10, "coalesce(bool_or(regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND length(v) < 10), false)"
        ) + " AS is_code_like" for c in TEXTS
    )
    q["estimate_numeric"] = D + f"SELECT {_amount('amount_txt')} AS amount_txt FROM d WHERE {_amount('amount_txt')} IS NOT NULL"

    q["numeric_candidates"] = D + _union(_candidate(c) for c in TEXTS)
    q["numeric_candidates_full"] = D + _union(
        f"SELECT '{c}' AS \"column\" FROM d HAVING count({c}) > 0 AND count_if(regexp_matches(trim({c}), {_CODE})) = 0 "
        f"AND count_if(regexp_full_match(trim({c}), {_LOOK})) >= 0.9 * count({c})" for c in TEXTS
    )
    q["normalize_case_full"] = q["normalize_case"]
    q["dominant_scale"] = D + _union(
        f"(SELECT '{c}' AS \"column\", CAST(regexp_extract({c}, {_GRADE}, 2) AS DOUBLE) AS scale, count(*) AS n "
        f"FROM d WHERE regexp_full_match({c}, {_GRADE}) GROUP BY 2 ORDER BY n DESC, scale DESC LIMIT 1)"
        for c in ("note_txt", "note20_txt")
    )
    q["rescaled_grades"] = (
        D + "SELECT 'note20_txt' AS \"column\", count(*) AS n_values, '4/5 → 16' AS examples, 20.0::DOUBLE AS scale "
        "FROM d WHERE note20_txt = '4/5'"
    )
    numeric = {
        "amount_txt": _amount("amount_txt"),
        "note_txt": f"CAST({_graded('note_txt', 5)} AS DOUBLE)",
        "note20_txt": f"CAST({_graded('note20_txt', 20)} AS DOUBLE)",
        "rate_txt": _PERCENT,
    }
    q["convert_numeric"] = D + "SELECT id, amount_early, " + ", ".join(f"{e} AS {c}" for c, e in numeric.items()) + " FROM d"
    q["convert_dates"] = D + f"SELECT id, {_date()} AS date_txt, phone FROM d"
    q["clean_types"] = D + "SELECT * REPLACE (" + ", ".join(
        f"{e} AS {c}" for c, e in (numeric | {"date_txt": _date()}).items()
    ) + ") FROM d"
    # Of all values of amount_early one in 97 is no number; its first ones hold one.
    everything = numeric | {"date_txt": _date(), "amount_early": _amount("amount_early")}
    q["clean_types_full"] = D + "SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in everything.items()) + ") FROM d"
    q["recover_integers"] = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, l_discount FROM lineitem"
    q["unparsed_values"] = D + _union([
        f"SELECT 'amount_txt' AS \"column\", count(*) AS n_values, 'trop flou' AS examples FROM d WHERE {_amount('amount_txt')} IS NULL",
        f"SELECT 'date_txt' AS \"column\", count(*) AS n_values, '0197-08-14' AS examples FROM d WHERE {_date()} IS NULL",
    ])
    q["mistyped_columns"] = D + _union(
        [_candidate(c).replace('AS "column" WHERE', 'AS "column", \'number\' AS reads_as WHERE') for c in TEXTS]
        + [f"SELECT 'date_txt' AS \"column\", 'date' AS reads_as FROM d HAVING count({_date(False)}) / count(date_txt) > 0.8"]
    )

    q["profile_shape"] = "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders"
    q["profile_missing"] = D + _union(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, "
        f"round((count(*) - count({c})) / count(*) * 100, 2) AS pct_missing FROM d" for c in COLUMNS
    )
    q["missing_summary"] = D + "SELECT * FROM (" + _union(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, "
        f"round((count(*) - count({c})) / count(*) * 100, 1) AS pct_missing FROM d" for c in COLUMNS
    ) + ") WHERE n_missing > 0"
    q["duplicate_count"] = D + "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS n_duplicates FROM d"
    q["row_quality"] = (
        f"{D}, {_ROWS} SELECT count(*) AS n_rows, count(*) FILTER (pct > 90) AS full_empty, "
        "count(*) FILTER (pct BETWEEN 30 AND 90) AS partially_empty FROM rows_"
    )
    q["row_alerts"] = f"""{D}, {_ROWS},
g AS (SELECT pct, count(*) AS n FROM rows_ WHERE pct BETWEEN 30 AND 90 GROUP BY pct),
f AS (SELECT pct, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM
  (SELECT pct, id, row_number() OVER (PARTITION BY pct ORDER BY id) AS rn FROM rows_) WHERE rn <= 10 GROUP BY pct)
SELECT 'row_partially_empty' AS type, b.pct AS percentage, b.n AS n_rows, f.ids AS rows FROM g AS b JOIN f USING (pct)
UNION ALL SELECT 'row_full_empty', NULL, count(*), '' FROM rows_ WHERE pct > 90 HAVING count(*) > 0"""
    q["describe_numeric"] = _union(_describe("lineitem", c) for c in _numeric("lineitem"))
    q["profile_outliers"] = D + _union(_fence(t, c) for t in ("events", "orders", "d") for c in _numeric(t))
    q["iqr_bounds"] = _union(_bounds(t, c) for t in ("orders", "events", "lineitem") for c in _numeric(t))
    q["count_outliers_k3"] = _union(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (q1 <> q3 AND ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1))) "
        f"AS n_outliers FROM events, {_quartiles('events', c)}" for c in _numeric("events")
    )
    rough = ", ".join(f"{e} AS {c}" for c, e in {
        "amount_txt": _amount("amount_txt"), "note_txt": _number("note_txt"), "note20_txt": _number("note20_txt"),
    }.items())
    latent = lambda c: (
        f"SELECT '{c}' AS \"column\", count(*) AS n_outliers, true AS latent FROM rough, {_quartiles('rough', c)} "
        f"WHERE q1 <> q3 AND ({c} < {lo} OR {c} > {hi}) HAVING count(*) > 0"
    )
    q["outlier_summary"] = f"{D}, rough AS (SELECT {rough} FROM d) " + _union(
        [f"SELECT \"column\", n_outliers, false AS latent FROM ({_fence('d', c)})" for c in _numeric("d")]
        + [latent(c) for c in ("amount_txt", "note_txt", "note20_txt")]
    )
    cats = [("orders", c) for c in ("o_orderstatus", "o_orderpriority")]
    cats += [("part", c) for c in ("p_name", "p_brand", "p_type")] + [("d", c) for c in TEXTS]
    q["profile_categorical"] = D + _union(_categorical(t, c) for t, c in cats)
    q["top_categories"] = _union(
        f"(SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, value LIMIT 10)"
        for c in ("p_name", "p_brand", "p_type")
    )
    q["top_categories_texts"] = _union(
        f"(SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, '{t}' AS source FROM {t} WHERE {c} IS NOT NULL "
        "GROUP BY 2 ORDER BY n DESC, value LIMIT 10)"
        for t, columns in (("documents", ("text", "lang", "source")), ("conversations", ("role", "text"))) for c in columns
    )
    q["frequency_skew"] = "SELECT \"column\", skewness_frequency, is_high_skewness FROM (" + _union(
        _categorical("documents", c) for c in ("text", "lang", "source")
    ) + ")"
    q["format_anomalies"] = D + _union(_anomaly(c) for c in TEXTS)
    q["case_targets"] = D + "SELECT \"column\" FROM (" + _union(_anomaly(c) for c in TEXTS) + ") WHERE case_anomaly"
    q["identifier_columns"] = _union(
        _identifier(t, c) for t, cs in (
            ("customer", ("c_name", "c_mktsegment")), ("part", ("p_name", "p_brand", "p_type")),
            ("documents", ("text", "lang", "source")),
        ) for c in cs
    )
    kinds = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
             "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
    q["column_overview"] = _union(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) - count({c}) AS n_missing, "
        f"count(DISTINCT {c}) AS n_distinct FROM orders" for c, t in kinds.items()
    )
    q["correlation_matrix"] = _corr(_numeric("lineitem"))
    q["histogram_20"] = """WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders),
h AS (SELECT least(floor((o_totalprice - lo) / w), 19) AS bin, count(*) AS n FROM orders, s WHERE o_totalprice IS NOT NULL GROUP BY 1)
SELECT i AS bin, round(lo + i * w, 6) AS lower, round(lo + (i + 1) * w, 6) AS upper, coalesce(n, 0) AS n
FROM s, range(20) AS r(i) LEFT JOIN h ON h.bin = i"""
    q["histogram_auto"] = """WITH p AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
s AS (SELECT lo, n, hi - lo AS span, greatest(2 * iqr / pow(n, 1.0 / 3), (hi - lo) / sqrt(n) / 2) AS fd, (hi - lo) / (log2(n) + 1) AS sturges FROM p),
b AS (SELECT lo, CAST(greatest(1, ceil(span / least(fd, sturges))) AS BIGINT) AS k, span FROM s),
h AS (SELECT CAST(least(floor((value - lo) / (span / k)), k - 1) AS BIGINT) AS bin, count(*) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1)
SELECT i AS bin, round(lo + i * (span / k), 6) AS lower, round(lo + (i + 1) * (span / k), 6) AS upper, coalesce(h.n, 0) AS n
FROM (SELECT unnest(generate_series(0, k - 1)) AS i, lo, span, k FROM b) LEFT JOIN h ON h.bin = i"""
    q["kde_grid"] = _density()
    q["boxplot_stats"] = _union(_box(t, c) for t in ("orders", "events") for c in _numeric(t))
    q["top_n_bar"] = "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 10"
    q["scatter_sample"] = D + """SELECT DISTINCT id, whole_gap, price_out, md5(id::VARCHAR) AS m FROM d
WHERE whole_gap IS NOT NULL AND price_out IS NOT NULL ORDER BY m LIMIT 500"""
    q["scatter_sample"] = f"SELECT id, whole_gap, price_out FROM ({q['scatter_sample']})"
    orders = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    q["profile_distinct_sketch"] = _union(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_present, count(DISTINCT {c}) AS n_distinct, true AS within_bound FROM orders"
        for c in orders
    )
    every = _numeric("lineitem")
    q["scatter_points"] = f"SELECT {', '.join(every)} FROM lineitem WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in every)

    q["drop_duplicates"] = D + "SELECT DISTINCT * FROM d"
    clip = lambda t, c, k: (
        f"SELECT q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi FROM {_quartiles(t, c)}"
    )
    q["clip_outliers"] = D + (
        f", w AS ({clip('d', 'whole_gap', 1.5)}), p AS ({clip('d', 'price_out', 1.5)}) "
        "SELECT id, CASE WHEN whole_gap IS NOT NULL THEN round(greatest(w.lo, least(w.hi, whole_gap)), 6) END AS whole_gap, "
        "CASE WHEN price_out IS NOT NULL THEN round(greatest(p.lo, least(p.hi, price_out)), 6) END AS price_out FROM d, w, p"
    )
    q["clip_outliers_per_column"] = (
        f"WITH v AS ({clip('events', 'value', 0.5)}) SELECT event_id, user_id, "
        "CASE WHEN value IS NOT NULL THEN round(greatest(lo, least(hi, value)), 6) END AS value FROM events, v"
    )
    q["fill_missing"] = D + "SELECT * REPLACE (" + ", ".join(
        [f"coalesce({c}, {_mode('d', c)}) AS {c}" for c in ("note_txt", "mostly_null", "prio_gap")]
        + [f"round(coalesce({c}, {_median('d', c)}), 6) AS {c}" for c in ("whole_gap", "price_out")]
    ) + ") FROM d"
    q["cleaned_table"] = RUN + """SELECT id, ref, round(amount_txt, 6) AS amount_txt, amount_early, date_txt,
round(CAST(note_txt AS DOUBLE), 6) AS note_txt, CAST(note20_txt AS DOUBLE) AS note20_txt, round(rate_txt, 6) AS rate_txt,
city, phone, round(CAST(whole_gap AS DOUBLE), 6) AS whole_gap, prio_gap,
round(greatest(lo, least(hi, price_out)), 6) AS price_out FROM filled, fence"""
    typed_full = TYPED.replace(" amount_early,", f" {_amount('amount_early')} AS amount_early,")
    q["cleaned_table_full"] = f"""{D}, {typed_full} SELECT DISTINCT id, ref, round(amount_txt, 6) AS amount_txt,
round(amount_early, 6) AS amount_early, date_txt, CAST(note_txt AS DOUBLE) AS note_txt, CAST(note20_txt AS DOUBLE) AS note20_txt,
round(rate_txt, 6) AS rate_txt, city, phone, CAST(whole_gap AS DOUBLE) AS whole_gap, prio_gap, round(price_out, 6) AS price_out FROM typed"""
    q["reapplied_plan"] = (
        f"{D}, {TYPED} SELECT id, amount_txt, date_txt, CAST(note_txt AS DOUBLE) AS note_txt, "
        "CAST(note20_txt AS DOUBLE) AS note20_txt, rate_txt, city, CAST(whole_gap AS DOUBLE) AS whole_gap FROM typed"
    )
    q["cleaning_totals"] = _step_totals(consent=True, ignored=False)
    q["step_totals"] = _step_totals(consent=False, ignored=True)
    head = [
        ("rows_before", "(SELECT count(*) FROM d)"), ("rows_after", "(SELECT count(*) FROM uniq)"),
        ("columns_before", str(len(COLUMNS))), ("columns_after", str(len(COLUMNS) - 1)),
    ]
    q["audit_summary"] = RUN + _union(
        f"SELECT '{i}' AS item, CAST({v} AS BIGINT) AS total"
        for i, v in head + [(s, v) for s, _, v in _totals(True)]
    )
    q["audit_table"] = _audit_sql()
    q["type_changes"] = _values(
        [(c, _TYPES_BEFORE[c], t) for c, t in _TYPES_AFTER.items() if t != _TYPES_BEFORE[c]],
        '"column", type_before, type_after',
    )
    missing = " + ".join(f"(count(*) - count({c}))" for c in COLUMNS)
    q["global_metrics"] = (
        f"{D} SELECT count(*) AS n_rows, CAST({len(COLUMNS)} AS BIGINT) AS n_columns, "
        "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS n_duplicates, "
        f"{missing} AS n_missing FROM d"
    )
    after = " + ".join(f"(count(*) - count({c}))" for c in COLUMNS if c != "mostly_null")
    sides = {
        "n_rows": ("(SELECT count(*) FROM d)", "(SELECT count(*) FROM uniq)"),
        "n_columns": (str(len(COLUMNS)), str(len(COLUMNS) - 1)),
        "n_missing": (f"(SELECT {missing} FROM d)", f"(SELECT {after} FROM uniq)"),
    }
    q["before_after_delta"] = RUN + _union(
        f"SELECT '{m}' AS metric, CAST({a} AS BIGINT) AS before, CAST({b} AS BIGINT) AS after, "
        f"CAST({b} - {a} AS BIGINT) AS delta" for m, (a, b) in sides.items()
    )
    q["report_history"] = D + ", u AS (SELECT DISTINCT * FROM d) " + _union(
        f"SELECT '{c}' AS \"column\", metric, {'b' if c != 'copies' else 'NULL::DOUBLE'} AS before, "
        f"{'a' if c != 'mostly_null' else 'NULL::DOUBLE'} AS after, "
        f"{'a - b' if c not in ('copies', 'mostly_null') else 'NULL::DOUBLE'} AS delta, "
        + {"copies": "'added'", "mostly_null": "'removed'"}.get(c, "CASE WHEN a = b THEN 'same' ELSE 'changed' END")
        + f" AS status FROM (SELECT 'n_missing' AS metric, (SELECT count(*) - count({v}) FROM d)::DOUBLE AS b, "
        f"(SELECT count(*) - count({v}) FROM u)::DOUBLE AS a UNION ALL SELECT 'pct_missing', "
        f"(SELECT round((count(*) - count({v})) / count(*) * 100, 2) FROM d), "
        f"(SELECT round((count(*) - count({v})) / count(*) * 100, 2) FROM u))"
        for c, v in [*[(c, c) for c in COLUMNS], ("copies", "id")]
    )
    q["control_verdict"] = _values(
        [(c, _TYPES_AFTER[c], True, None) for c in _TYPES_AFTER], '"column", type, well_typed, reads_as'
    )
    return q
