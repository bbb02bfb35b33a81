"""Rater-output parsing as native Column expressions.

``parse_scores`` turns raw model text into ``struct<grammar, lexical,
coherence, task>`` (strict JSON shape first, then the first four standalone
digits); ``score_field`` falls back to a whole-JSON ``raw``; ``total_score``
needs all four values.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# ---------------------------------------------------------------------------
SCORE_FIELDS = ["grammar", "lexical", "coherence", "task"]
# Strict shape: the four keys in this order, integer values, anywhere in the text.
STRICT_PATTERN = (
    r'\{\s*"grammar"\s*:\s*(\d+),\s*"lexical"\s*:\s*(\d+),'
    r'\s*"coherence"\s*:\s*(\d+),\s*"task"\s*:\s*(\d+)\s*\}'
)
# Fallback: standalone single digits, first four in text order.
DIGIT_PATTERN = r"\b([0-9])\b"
DRY_RUN_TEXT = '{"grammar": 7, "lexical": 7, "coherence": 7, "task": 7}'
ERROR_PREFIX = "ERROR: "
# ---------------------------------------------------------------------------

# White space, digits and word borders are Unicode's, as in Python.
STRICT = "(?U)" + STRICT_PATTERN
DIGIT = "(?U)" + DIGIT_PATTERN
_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_DIGIT_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)

# A text that can be one JSON object begins and ends with braces.
# ("any character" is a dot: the class [\s\S] costs eight times as much)
_BRACED = r"(?s)^\s*\{.*\}\s*$"
# The reader stops after a value, so only what stands inside another value is read to its end.
_IN_LIST = "v array<struct<_:string>>, _rest string"
_IN_OBJECT = "v struct<_:string>, _rest string"
_STRICT_JSON = {"allowSingleQuotes": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rest"}
_RAW_JSON_SCHEMA = "grammar string, lexical string, coherence string, task string"

SCORES_TYPE = "struct<grammar:bigint,lexical:bigint,coherence:bigint,task:bigint>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _to_long(c: Column) -> Column:
    return F.translate(c, "".join(_DIGITS), _DIGIT_VALUES).try_cast("bigint")


def strict_match(raw: Column | str) -> Column:
    """True where the strict four-key object occurs in the text."""
    return F.coalesce(_col(raw).rlike(STRICT), F.lit(False))


def strict_scores(raw: Column | str) -> Column:
    """Struct of the four integers of the first strict match, else NULL."""
    r = _col(raw)
    fields = [_to_long(F.regexp_extract(r, STRICT, i + 1)).alias(k) for i, k in enumerate(SCORE_FIELDS)]
    return F.when(strict_match(r), F.struct(*fields))


def digit_tokens(raw: Column | str) -> Column:
    """Standalone single digits of the text, in order."""
    return F.regexp_extract_all(_col(raw), F.lit(DIGIT), F.lit(1))


def digit_scores(raw: Column | str) -> Column:
    """R2: first four standalone digits as grammar, lexical, coherence, task; NULL if fewer than four."""
    d = digit_tokens(raw)
    fields = [_to_long(F.element_at(d, i + 1)).alias(k) for i, k in enumerate(SCORE_FIELDS)]
    return F.when(F.size(d) >= 4, F.struct(*fields))


def parse_scores(raw: Column | str) -> Column:
    """R1 then R2: the parsed struct a scorer run records, NULL when nothing parses."""
    r = _col(raw)
    return F.when(strict_match(r), strict_scores(r)).otherwise(digit_scores(r))


def parse_method(raw: Column | str) -> Column:
    """'strict', 'digits' or 'none' (which branch of parse_scores produced the scores)."""
    r = _col(raw)
    return (
        F.when(strict_match(r), F.lit("strict"))
        .when(F.coalesce(F.size(digit_tokens(r)) >= 4, F.lit(False)), F.lit("digits"))
        .otherwise(F.lit("none"))
    )


def is_json_object(text: Column | str) -> Column:
    """Whether the whole text is one JSON object: nothing but white space after it, no second object.

    The text is read twice, as the only element of a list and as a member of an object. What follows the
    first object would have to begin with a bracket, or a comma and a value, to pass the one, and with a
    brace, or a comma and a name with a colon, to pass the other; nothing does both.
    """
    t = _col(text)
    in_list = F.from_json(F.concat(F.lit('{"v":['), t, F.lit("]}")), _IN_LIST, _STRICT_JSON)
    in_object = F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), _IN_OBJECT, _STRICT_JSON)
    one = (F.size(in_list["v"]) == 1) & in_list["_rest"].isNull() & in_object["v"].isNotNull() & in_object["_rest"].isNull()
    return F.when(t.rlike(_BRACED), F.coalesce(one, F.lit(False))).otherwise(F.lit(False))


def raw_json_field(raw: Column | str, key: str) -> Column:
    """The value of ``key`` when the whole raw text is one JSON object, else NULL (as string)."""
    r = _col(raw)
    obj = F.from_json(r, _RAW_JSON_SCHEMA, {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.when(is_json_object(r), obj.getField(key))


def score_field(parsed: Column | str, raw: Column | str, key: str) -> Column:
    """R3 + R4: parsed[key] when parsed exists, else raw JSON's key; coerced to double, failures NULL."""
    p = _col(parsed)
    from_parsed = p.getField(key).try_cast("double")
    from_raw = raw_json_field(raw, key).try_cast("double")
    return F.when(p.isNotNull(), from_parsed).otherwise(from_raw)


# The strict object anywhere in the text, rewritten to "g,l,c,t" in one regex pass.
_STRICT_WHOLE = r"(?Us)^.*?" + STRICT_PATTERN + r".*$"


def with_parsed(df, raw: str = "raw", out: str = "parsed"):
    """``parse_scores`` as staged columns: each regex runs once per row (the strict test,
    one rewrite for matching rows, one digit scan for the others). Intermediate columns
    are referenced several times, so Catalyst keeps them computed once."""
    r = F.col(raw)
    staged = df.withColumn("_p_strict", strict_match(r))
    staged = staged.withColumn(
        "_p_vals",
        F.when(F.col("_p_strict"), F.split(F.regexp_replace(r, _STRICT_WHOLE, "$1,$2,$3,$4"), ","))
        .otherwise(digit_tokens(r)),
    )
    v = F.col("_p_vals")
    fields = [_to_long(F.element_at(v, i + 1)).alias(k) for i, k in enumerate(SCORE_FIELDS)]
    parsed = F.when(F.col("_p_strict") | (F.size(v) >= 4), F.struct(*fields))
    return staged.withColumn(out, parsed).drop("_p_strict", "_p_vals")


def with_scores(df, parsed: str = "parsed", raw: str = "raw"):
    """R3/R4 on a DataFrame: adds the four score columns and ``total_score`` (NULL unless all four).

    The raw-JSON fallback (``from_json`` runs outside whole-stage codegen) is its own
    column, evaluated only for rows without parsed scores; the score projection stays
    code-generated.
    """
    p = F.col(parsed)
    r = F.col(raw)
    fallback = F.from_json(r, _RAW_JSON_SCHEMA, {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    staged = df.withColumn("_raw_json", F.when(p.isNull() & F.coalesce(r.rlike(_BRACED), F.lit(False)), F.when(is_json_object(r), fallback)))
    scores = {
        k: F.when(p.isNotNull(), p.getField(k).try_cast("double")).otherwise(
            F.col("_raw_json").getField(k).try_cast("double"))
        for k in SCORE_FIELDS
    }
    total = None
    for k in SCORE_FIELDS:
        total = F.col(k) if total is None else total + F.col(k)
    return staged.withColumns(scores).withColumn("total_score", total).drop("_raw_json")


def is_error(raw: Column | str) -> Column:
    """The scorer call raised; its message was recorded as raw text."""
    return F.coalesce(_col(raw).startswith(ERROR_PREFIX.rstrip()), F.lit(False))
