"""Scalar expressions with the reference semantics, as Column helpers and as SQL temporary functions.

All are compositions of built-in expressions, so they stay inside code generation and need no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ColumnOrName = Column | str
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LONG_MIN, _LONG_MAX = -(2**63), 2**63 - 1


def _col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_space(x: ColumnOrName) -> Column:
    """Strips Unicode white space on both ends (the built-in trim strips blanks only)."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def length(x: ColumnOrName) -> Column:
    return F.length(_col(x)).cast("bigint")


def concat(*parts: ColumnOrName) -> Column:
    """Leaves nulls out instead of returning null."""
    return F.concat_ws("", *[_col(p).cast("string") for p in parts])


def int_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Integer division that truncates towards zero; a zero divisor is an error."""
    a, b = _col(a), _col(b)
    return F.call_function("div", a, b)


def _saturate(x: Column) -> Column:
    low, high = F.lit(_LONG_MIN).cast("decimal(38,0)"), F.lit(_LONG_MAX).cast("decimal(38,0)")
    return F.least(F.greatest(x, low), high).cast("bigint")


def _wide(x: ColumnOrName) -> Column:
    return _col(x).cast("decimal(19,0)")


def sat_add(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _saturate((_wide(a) + _wide(b)).cast("decimal(38,0)"))


def sat_sub(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _saturate((_wide(a) - _wide(b)).cast("decimal(38,0)"))


def sat_mul(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Saturating product; decimal(38,0) holds any product of two longs short of (2**63)**2, which is caught before."""
    a, b = _col(a).cast("bigint"), _col(b).cast("bigint")
    product = F.try_multiply(a, b)
    limit = F.when((a < 0) == (b < 0), F.lit(_LONG_MAX)).otherwise(F.lit(_LONG_MIN))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce(product, limit))


def parse_timestamp(x: ColumnOrName) -> Column:
    """Text as epoch seconds, RFC 3339 or 'YYYY-MM-DD[ T]HH:MM:SS' (UTC); sub-seconds are cut; null if none fits."""
    x = _col(x)
    epoch = F.timestamp_seconds(x.try_cast("bigint"))
    return F.date_trunc("second", F.coalesce(epoch, x.try_cast("timestamp")))


# --- vectors ---------------------------------------------------------------------------------------------------------


def to_vector(x: ColumnOrName) -> Column:
    """'[a,b,...]' as an array of doubles."""
    return F.from_json(_col(x), "array<double>")


def vector_text(x: ColumnOrName) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_col(x), lambda v: v.cast("string")), ","), F.lit("]"))


def _checked(a: Column, b: Column, value: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("vector dimension mismatch: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(F.size(a) != F.size(b), wrong.cast("double")).otherwise(value)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _doubles(x: ColumnOrName) -> Column:
    return _col(x).cast("array<double>")


def l2_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    a, b = _doubles(a), _doubles(b)
    return _checked(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def cosine_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 - a.b / (|a||b|); a zero vector is an error."""
    a, b = _doubles(a), _doubles(b)
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    zero = F.raise_error(F.lit("cosine distance of a zero vector")).cast("double")
    return _checked(a, b, F.when(norm == 0, zero).otherwise(1 - _sum(F.zip_with(a, b, lambda x, y: x * y)) / norm))


# --- text tokens -----------------------------------------------------------------------------------------------------

# The stop words of the configuration 'english'.
STOP_WORDS = ("a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with")
CONFIGS = ("english", "simple")


def ascii_lower(x: ColumnOrName) -> Column:
    """A to Z in lower case, other letters as they are; lower(), which is faster, does that where every character is one byte."""
    x = _col(x).cast("string")
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def text_tokens(x: ColumnOrName, config: str = "simple") -> Column:
    """Runs of letters and digits, A to Z in lower case; 'english' leaves the stop words out."""
    if config not in CONFIGS:
        raise ValueError(f"unsupported text_config '{config}'")
    left_out = ("", *STOP_WORDS) if config == "english" else ("",)
    return F.filter(F.split(ascii_lower(x), r"[^\p{L}\p{N}]+"), lambda t: ~t.isin(*left_out))


def local_bm25(x: ColumnOrName, terms: list[str], k1: float = 1.2) -> Column:
    """Score without an index: sum over the query's terms of tf (k1 + 1) / (tf + k1); null text scores 0."""
    different = sorted(set(terms))

    def score(tokens: Column) -> Column:
        tf = {t: F.size(F.filter(tokens, lambda w: w == t)).cast("double") for t in different}  # noqa: B023
        return sum((F.when(tf[t] > 0, tf[t] * (k1 + 1) / (tf[t] + k1)).otherwise(0.0) for t in terms), F.lit(0.0))

    hits = F.filter(text_tokens(x), lambda w: w.isin(*different)) if different else F.array().cast("array<string>")
    named = F.transform(F.array(hits), score)  # an array of one, so that the text is cut once for all terms
    return F.when(_col(x).isNull(), F.lit(0.0)).otherwise(F.element_at(named, 1))


def query_terms(text: str, config: str = "simple") -> list[str]:
    """The driver's twin of text_tokens, for query literals."""
    terms = "".join(c if c.isalpha() or c.isnumeric() else " " for c in text.translate(str.maketrans(UPPER, LOWER))).split()
    return [t for t in terms if config != "english" or t not in STOP_WORDS]


# --- SQL -------------------------------------------------------------------------------------------------------------

SQL_FUNCTIONS = {
    "trim_space(x STRING) RETURNS STRING": r"regexp_replace(x, '(?U)^\\s+|\\s+$', '')",
    "text_concat2(a STRING, b STRING) RETURNS STRING": "concat_ws('', a, b)",
    "to_vector(x STRING) RETURNS ARRAY<DOUBLE>": "from_json(x, 'array<double>')",
    "l2_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN size(a) <> size(b) THEN CAST(raise_error('vector dimension mismatch') AS DOUBLE) ELSE sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)) END",
    "cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN size(a) <> size(b) THEN CAST(raise_error('vector dimension mismatch') AS DOUBLE) WHEN aggregate(a, 0D, (s, v) -> s + v * v) = 0 OR aggregate(b, 0D, (s, v) -> s + v * v) = 0 THEN CAST(raise_error('cosine distance of a zero vector') AS DOUBLE) ELSE 1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / (sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v))) END",
    "ascii_lower(x STRING) RETURNS STRING": f"CASE WHEN octet_length(x) = length(x) THEN lower(x) ELSE translate(x, '{UPPER}', '{LOWER}') END",
    "text_tokens(x STRING) RETURNS ARRAY<STRING>": r"filter(split(ascii_lower(x), '[^\\p{L}\\p{N}]+'), t -> t <> '')",
    "bm25_score(x STRING, terms ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN x IS NULL THEN 0D ELSE element_at(transform(array(text_tokens(x)), ts -> aggregate(transform(terms, t -> CAST(size(filter(ts, w -> w = t)) AS DOUBLE)), 0D, (s, tf) -> s + CASE WHEN tf > 0 THEN tf * 2.2D / (tf + 1.2D) ELSE 0D END)), 1) END",
    "to_bm25query(query STRING, index_name STRING) RETURNS ARRAY<STRING>": "text_tokens(query)",
}


def install(spark: SparkSession) -> None:
    """Registers the functions for spark.sql; Catalyst inlines their bodies."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
