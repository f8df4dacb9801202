"""Fixed values of the product: thresholds, patterns and word lists.

Every value below decides results, so each must stay exactly as written.
"""

# Thresholds.
EMPTY_COLUMN_RATIO = 0.95        # a column at or above this null ratio is dropped
NUMERIC_ACCEPTANCE = 0.9         # strictly more converted / present than this
DATE_ACCEPTANCE = 0.8            # strictly more converted / present than this
NUMERIC_SAMPLE = 100             # present values looked at before a numeric conversion
CASE_SAMPLE = 10                 # present values looked at before lowering a column
FULL_SCAN_RATE = 0.9             # share of all present values that decides where no sample does
YEAR_MIN, YEAR_MAX = 1900, 2100  # inclusive bounds of a plausible year
IQR_FACTOR = 1.5
IQR_MIN_VALUES = 2
LATENT_MIN_VALUES = 4
EXAMPLES_KEPT = 5
ROW_EMPTY_PCT = 90.0             # strictly above: the row is empty
ROW_PARTIAL_PCT = 30.0           # from here to ROW_EMPTY_PCT: partly empty
ROW_IDS_SHOWN = 10
SKEW_PCT = 90.0
IDENTIFIER_MIN_VALUES = 20
IDENTIFIER_RATIO = 0.9
MAX_PASSES = 5
TOP_CATEGORIES = 10
HISTOGRAM_BINS = 20
DENSITY_POINTS = 200
UNKNOWN = "Inconnu"              # fill value of a text column that holds no value at all

# Written forms of "no value"; compared after trimming and lowercasing.
MISSING_MARKERS = ("", "nan", "none", "null", "na", "n/a", "-", "--")
# Lowercased words that the case treatment leaves alone.
CASE_EXEMPT = ("nan", "none", "na", "null")
# Tokens a CSV cell may hold for "no value".
CSV_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
CSV_TRUE = ("True", "TRUE", "true")
CSV_FALSE = ("False", "FALSE", "false")

# Everything that counts as white space, as ranges of code points.
WS_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
WS_CHARS = "".join(chr(n) for first, last in WS_RANGES for n in range(first, last + 1))


def _one_of(ranges) -> str:
    return "[" + "".join(f"\\u{first:04x}-\\u{last:04x}" for first, last in ranges) + "]"


# Pattern of one of them, and of one other than the plain space, which ends its range.
WS = _one_of(WS_RANGES)
WS_NOT_SPACE = _one_of((first, last - (last == 0x20)) for first, last in WS_RANGES)

# Patterns, in Java syntax.
CODE_PATTERN = r"^[+-]?0\d(?:\d|" + WS + r")*$"
GRADE_PATTERN = r"^([+-]?\d+(?:[.,]\d+)?)" + WS + r"*/" + WS + r"*(\d+(?:[.,]\d+)?)$"
PERCENT_PATTERN = r"^([+-]?\d+(?:[.,]\d+)?)" + WS + r"*%$"
AMOUNT_NOISE = "[€$£ \u00a0\u202f]"   # currency signs and thousands spaces
NUMERIC_LOOK_PATTERN = (           # plain or money characters only, or a percentage, or a grade
    "^(?:[0-9+\\-.,;€$£ \u00a0\u202f]*"
    r"|[+-]?\d+(?:[.,]\d+)?" + WS + r"*(?:%|/" + WS + r"*\d+(?:[.,]\d+)?))$"
)
MARKED_PATTERN = (                # a percentage or a grade; group 1 is its number
    r"^([+-]?\d+(?:[.,]\d+)?)" + WS + r"*(?:%|/" + WS + r"*\d+(?:[.,]\d+)?)$"
)
NUMBER_PATTERN = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
PLAIN_DECIMAL_PATTERN = r"^[+-]?(?:\d+\.?\d*|\.\d+)$"
EXPONENT_PATTERN = r"[eE]"

# Candidate separators of a CSV file, in order.
DELIMITERS = (";", ",", "\t", "|")
PARQUET_MAGIC = b"PAR1"

# Audit step names, in report order, with the unit each is counted in.
STEPS = (
    ("empty_cols_dropped", "columns"),
    ("whitespace_cleaned", "values"),
    ("case_normalized", "values"),
    ("types_fixed", "columns"),
    ("types_converted", "columns"),
    ("values_unparsed", "values"),
    ("grades_rescaled", "values"),
    ("duplicates_removed", "rows"),
    ("missing_filled", "values"),
    ("outliers_corrected", "values"),
)
