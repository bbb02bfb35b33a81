"""Text scalar functions as native Spark Column expressions.

Each function maps Column -> Column and stays inside whole-stage codegen: no
Python UDF runs per row. Java regexes use ``(?U)`` so that ``\\s`` and the
letter/digit classes follow Unicode like Python's ``re`` does on ``str``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# ---------------------------------------------------------------------------
# Tokens removed before anything else, in this order.
REMOVED_TOKENS = ["@CAPS1", "@CAPS2"]
# Entity replacements, applied one after another in this order.
ENTITY_REPLACEMENTS = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
# Category rules: first rule with any keyword contained in the lower-cased question wins.
CATEGORY_RULES = [
    ("data_report", ["chart", "charts", "pie", "bar chart", "describe the information", "write a report"]),
    ("social_policy_opinion", ["government", "retire", "retired", "pension", "support", "take care of themselves"]),
    ("tech_society_opinion", ["robot", "robots", "technology", "dangerous", "future", "society"]),
    ("opinion", ["discuss", "opinion", "give your opinion"]),
]
CATEGORY_DEFAULT = "other"
CATEGORY_EMPTY = "unknown"
# Stop words whose presence (two distinct ones or more) marks a text as Indonesian.
INDONESIAN_STOPWORDS = [
    "dan", "yang", "tidak", "ada", "saya", "kamu", "kita", "kami", "untuk", "dengan", "di", "ke", "oleh",
    "ini", "itu", "sebuah", "adalah", "atau", "pada", "dari",
]
STOPWORD_MIN_HITS = 2
# Keyboard-mash fragments that mark gibberish (searched in the lower-cased text).
GIBBERISH_FRAGMENTS = ["qwerty", "asdf", "zxcv", "hjkl", "11111", "aaaaa"]
GIBBERISH_SYMBOL_RATIO = 0.3
GIBBERISH_SINGLE_CHAR_RATIO = 0.4
DEFAULT_SALT = "raterkit-default-salt"
ANON_ID_LENGTH = 12
SHORT_HASH_LENGTH = 16
# ---------------------------------------------------------------------------

_CONTROL_RUN = r"[\x00-\x1f\x7f]+"
_BLANK_RUN = r"(?U)\s+"
# Python's str.isspace() also holds for U+001C..U+001F; Unicode White_Space does not.
_ALNUM_OR_SPACE = r"(?U)[\p{L}\p{N}\s\x1c-\x1f]"
# Only these literals can survive one normalize pass and change on a second one.
_RENORMALIZE_HINT = r"@CAPS[12]|&(?:nbsp|amp|lt|gt);"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_replace(c: Column, search: str, repl: str) -> Column:
    return F.replace(c, F.lit(search), F.lit(repl))


def normalize_text(c: Column | str) -> Column:
    """NULL -> ''; drop @CAPS1/@CAPS2; control runs -> ' '; 4 entities in order; blank runs -> ' '; strip."""
    s = F.coalesce(_col(c).cast("string"), F.lit(""))
    for tok in REMOVED_TOKENS:
        s = _lit_replace(s, tok, "")
    s = F.regexp_replace(s, _CONTROL_RUN, " ")
    for search, repl in ENTITY_REPLACEMENTS:
        s = _lit_replace(s, search, repl)
    s = F.regexp_replace(s, _BLANK_RUN, " ")
    # after the blank collapse only ' ' can lead or trail
    return F.trim(s)


def renormalize(normalized: Column) -> Column:
    """normalize_text applied to already-normalized text, evaluated only where it can change anything."""
    return F.when(normalized.rlike(_RENORMALIZE_HINT), normalize_text(normalized)).otherwise(normalized)


def token_count(normalized: Column) -> Column:
    """Tokens of already-normalized text (single spaces, stripped); 0 for ''."""
    return F.when(normalized == "", F.lit(0)).otherwise(F.size(F.split(normalized, " ")))


def word_count(c: Column | str, normalized: bool = False) -> Column:
    """T4: number of tokens of the normalized text; 0 for empty/NULL.

    With ``normalized=True`` the input is already normalized text, and the
    (rarely effective) second normalization is applied only where it matters.
    """
    n = renormalize(_col(c)) if normalized else normalize_text(c)
    return token_count(n)


def ustrip(c: Column | str) -> Column:
    """Python ``str.strip()``: removes Unicode blanks at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def anonymize_id(c: Column | str, salt: str | None = None, length: int = ANON_ID_LENGTH) -> Column:
    """First ``length`` hex chars of sha256(value || salt); NULL stays NULL.

    A missing salt falls back to the default one (the reference raises instead).
    """
    v = _col(c).cast("string")
    salt = DEFAULT_SALT if salt is None else salt
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(
        F.substring(F.sha2(F.concat(v, F.lit(salt)), 256), 1, length)
    )


def short_hash(c: Column | str, length: int = SHORT_HASH_LENGTH) -> Column:
    """First ``length`` hex chars of sha256 (64 = full hash, used for dedupe keys)."""
    h = F.sha2(_col(c).cast("string"), 256)
    return h if length >= 64 else F.substring(h, 1, length)


def detect_category(c: Column | str, rules: Sequence[tuple[str, Sequence[str]]] = CATEGORY_RULES) -> Column:
    """Ordered substring rules on the lower-cased text; NULL/'' -> 'unknown'; no hit -> 'other'."""
    q = _col(c).cast("string")
    low = F.lower(q)
    expr = None
    for label, keywords in rules:
        hit = None
        for k in keywords:
            cond = low.contains(k)
            hit = cond if hit is None else (hit | cond)
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    expr = F.lit(CATEGORY_DEFAULT) if expr is None else expr.otherwise(F.lit(CATEGORY_DEFAULT))
    return F.when(q.isNull() | (q == ""), F.lit(CATEGORY_EMPTY)).otherwise(expr)


def stopword_hits(c: Column | str, words: Sequence[str] = INDONESIAN_STOPWORDS, normalized: bool = False,
                  already: bool = False) -> Column:
    """Number of distinct stop words present as whole tokens of the lower-cased normalized text.

    ``already=True``: the input went through both normalizations (use it as is)."""
    n = _col(c) if already else renormalize(_col(c)) if normalized else normalize_text(c)
    tokens = F.split(F.lower(n), " ")
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words])))


def contains_stopword_language(
    c: Column | str,
    words: Sequence[str] = INDONESIAN_STOPWORDS,
    min_hits: int = STOPWORD_MIN_HITS,
    normalized: bool = False,
) -> Column:
    """T5: at least ``min_hits`` distinct stop words of the list; NULL/'' -> false."""
    raw = _col(c).cast("string")
    hits = stopword_hits(raw, words, normalized=normalized)
    return F.when(raw.isNull() | (raw == ""), F.lit(False)).otherwise(hits >= min_hits)


def symbol_count(t: Column) -> Column:
    """Characters that are neither letters, digits nor blanks."""
    return F.length(F.regexp_replace(t, _ALNUM_OR_SPACE, ""))


def keyboard_mash(t: Column) -> Column:
    """A keyboard-mash fragment occurs in the lower-cased text."""
    return F.lower(t).rlike("|".join(GIBBERISH_FRAGMENTS))


def is_gibberish(c: Column | str) -> Column:
    """NULL/'' false; blank-only true; symbol share > 0.3; keyboard mash; single-char token share > 0.4."""
    raw = _col(c).cast("string")
    t = ustrip(raw)
    n = F.length(t)
    symbols = symbol_count(t)
    mash = keyboard_mash(t)
    tokens = F.split(t, r"(?U)[\s\x1c-\x1f]+")
    n_tokens = F.when(n == 0, F.lit(0)).otherwise(F.size(tokens))
    singles = F.size(F.filter(tokens, lambda x: F.length(x) == 1))
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(False))
        .when(n == 0, F.lit(True))
        .when(symbols / n > GIBBERISH_SYMBOL_RATIO, F.lit(True))
        .when(mash, F.lit(True))
        .when((n_tokens > 0) & (singles / n_tokens > GIBBERISH_SINGLE_CHAR_RATIO), F.lit(True))
        .otherwise(F.lit(False))
    )


def is_noisy_text(
    c: Column | str,
    words: Sequence[str] = INDONESIAN_STOPWORDS,
    min_hits: int = STOPWORD_MIN_HITS,
    normalized: bool = False,
) -> Column:
    """Gibberish, or written in the stop-word language (the detector's fallback rule)."""
    return is_gibberish(c) | contains_stopword_language(c, words, min_hits, normalized=normalized)


def path_safe(c: Column | str) -> Column:
    """T10: '/' and '\\' -> '_' (model names as folder names)."""
    return F.translate(_col(c), "/\\", "__")


def path_safe_name(name: str) -> str:
    """T10 for a name the caller holds (a parameter, not data)."""
    return name.replace("/", "_").replace("\\", "_")


def status_column_name(c: Column | str) -> Column:
    """T11: 'Flagged for Review' -> 'flagged_for_review'."""
    return F.lower(F.replace(_col(c), F.lit(" "), F.lit("_")))


def short_model_name(c: Column | str) -> Column:
    """The part after the last '/'."""
    return F.substring_index(_col(c), "/", -1)
