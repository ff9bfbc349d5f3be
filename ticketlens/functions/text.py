"""Text scalar operators as native column expressions (no Python UDFs).

Java regexes get ``(?U)`` so that ``\\s \\w \\d \\b`` are Unicode-aware, as in
the Python policy we reproduce.  Whitespace is an explicit class equal to
Python's ``str.isspace`` set, so NBSP and friends collapse the same way.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V


def char_class(ranges, negate: bool = False) -> str:
    parts = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return f"[{'^' if negate else ''}{parts}]"


WS_CLASS = char_class(V.WHITESPACE_RANGES)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rx(pattern: str, flags: str = "U") -> Column:
    return F.lit(f"(?{flags}){pattern}")


# B1 ---------------------------------------------------------------------------
def normalize_text(c) -> Column:
    """Null -> '', every whitespace run -> one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), WS_CLASS + "+", " "))


def strip(c) -> Column:
    """Without white space of any kind at either end (nulls stay null)."""
    return F.regexp_replace(_c(c).cast("string"), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


# B2-B8 ------------------------------------------------------------------------
def order_ids(c) -> Column:
    return F.regexp_extract_all(_c(c), _rx(V.ORDER_ID_PATTERN, "iU"), F.lit(1))


def tracking_ids(c) -> Column:
    return F.regexp_extract_all(_c(c), _rx(V.TRACKING_ID_PATTERN, "iU"), F.lit(1))


def transaction_ids(c) -> Column:
    return F.regexp_extract_all(_c(c), _rx(V.TRANSACTION_ID_PATTERN, "iU"), F.lit(1))


def card_refs(c) -> Column:
    return F.regexp_extract_all(_c(c), _rx(V.CARD_REF_PATTERN, "iU"), F.lit(1))


def amounts(c) -> Column:
    return F.regexp_extract_all(_c(c), _rx(V.AMOUNT_PATTERN, "U"), F.lit(0))


def dates(c) -> Column:
    return F.regexp_extract_all(_c(c), _rx(V.DATE_PATTERN, "iU"), F.lit(0))


def extract_entities(c, normalized: bool = False) -> Column:
    """Struct of the six entity arrays, extracted once from normalised text."""
    t = _c(c) if normalized else normalize_text(c)
    return F.struct(
        order_ids(t).alias("order_ids"),
        tracking_ids(t).alias("tracking_ids"),
        transaction_ids(t).alias("transaction_ids"),
        card_refs(t).alias("card_references"),
        amounts(t).alias("amounts"),
        dates(t).alias("dates"),
    )


# B9 ---------------------------------------------------------------------------
MASK_RULES = (
    ("email", V.EMAIL_PATTERN, "U", V.EMAIL_MARK),
    ("account", V.ACCOUNT_PATTERN, "iU", V.ACCOUNT_MARK),
    ("long_number", V.LONG_NUMBER_PATTERN, "U", V.LONG_NUMBER_MARK),
    ("phone", V.PHONE_PATTERN, "U", V.PHONE_MARK),
)


def mask_sensitive(c) -> Column:
    """Four PII rules applied in order on normalised text."""
    out = normalize_text(c)
    for _, pattern, flags, mark in MASK_RULES:
        out = F.regexp_replace(out, f"(?{flags}){pattern}", mark.replace("$", "\\$"))
    return out


# B10 --------------------------------------------------------------------------
def mask_reference_array(arr) -> Column:
    return F.transform(_c(arr), lambda x: F.when(F.length(x) > 4, F.concat(F.lit("***"), F.substring(x, -4, 4)))
                       .otherwise(F.lit(V.REDACTED)))


def mask_entities(entities) -> Column:
    e = _c(entities)
    return F.struct(*[
        (mask_reference_array(e[f]) if f in V.MASKED_ENTITY_FIELDS else e[f]).alias(f) for f in V.ENTITY_FIELDS
    ])


# B11 --------------------------------------------------------------------------
def mask_rule_hits(c) -> list[Column]:
    """Per rule, matches counted on the text the rule sees (after earlier rules)."""
    out = normalize_text(c)
    cols = []
    for name, pattern, flags, mark in MASK_RULES:
        rx = f"(?{flags}){pattern}"
        cols.append(F.regexp_count(out, F.lit(rx)).alias(f"{name}_hits"))
        out = F.regexp_replace(out, rx, mark)
    return cols


# B12 --------------------------------------------------------------------------
def canon_ref(c) -> Column:
    return F.upper(F.replace(F.coalesce(_c(c).cast("string"), F.lit("")), F.lit(" "), F.lit("")))


# B13 --------------------------------------------------------------------------
def script_language(c) -> Column:
    """Devanagari first, then the script ranges in order, else en if ASCII, else unknown."""
    t = F.coalesce(_c(c), F.lit(""))
    lo, hi, code = V.DEVANAGARI
    expr = F.when(t.rlike(char_class([(lo, hi)])), F.lit(code))
    for lo, hi, code in V.SCRIPT_RANGES:
        expr = expr.when(t.rlike(char_class([(lo, hi)])), F.lit(code))
    return expr.when(~t.rlike("[^\\x{0}-\\x{7F}]"), F.lit("en")).otherwise(F.lit("unknown"))


# B15 --------------------------------------------------------------------------
def language_name(code) -> Column:
    m = F.create_map(*[x for k, v in V.LANGUAGE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, _c(code)), F.lit(V.UNKNOWN_LANGUAGE))


def language_meta(code) -> Column:
    return F.struct(
        language_name(code).alias("source_language"),
        _c(code).alias("source_language_code"),
        F.lit(False).alias("translated"),
        F.lit(False).alias("translation_available"),
        F.lit(None).cast("string").alias("translation_backend"),
    )


# B16-B18 ----------------------------------------------------------------------
def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def query_type_for(intent) -> Column:
    key = F.lower(strip(F.coalesce(_c(intent).cast("string"), F.lit("None"))))
    return F.coalesce(F.try_element_at(_map(V.INTENT_TO_QUERY_TYPE), key), F.lit("other"))


def display_label(c) -> Column:
    return F.initcap(F.replace(_c(c), F.lit("_"), F.lit(" ")))


def department_for(query_type) -> Column:
    return F.coalesce(F.try_element_at(_map(V.DEPARTMENTS), _c(query_type)), F.lit(V.DEFAULT_DEPARTMENT))


# B19, B21 ---------------------------------------------------------------------
def _tokens(c, normalized: bool = False) -> Column:
    t = F.lower(_c(c) if normalized else normalize_text(c))
    return F.array_distinct(F.array_remove(F.split(t, " "), ""))


def lexicon_score(c, normalized: bool = False) -> Column:
    """Lexicon sentiment; no lambdas, so it stays cheap inside generated code."""
    toks = _tokens(c, normalized)
    pos = F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in V.POSITIVE_WORDS])))
    neg = F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in V.NEGATIVE_WORDS])))
    raw = F.lit(V.SENTIMENT_STEP) * pos.cast("double") - F.lit(V.SENTIMENT_STEP) * neg.cast("double")
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def polarity(score) -> Column:
    s = _c(score)
    return (F.when(s >= F.lit(V.SENTIMENT_STEP), F.lit("positive"))
            .when(s <= F.lit(-V.SENTIMENT_STEP), F.lit("negative"))
            .otherwise(F.lit("neutral")))


# B22 --------------------------------------------------------------------------
def pct(c) -> Column:
    """Percent text with 0 decimals, half-even like Python's ``{:.0%}``."""
    return F.concat(F.bround(_c(c) * F.lit(100.0), 0).cast("bigint").cast("string"), F.lit("%"))
