"""Answer-sheet cleaning: projection, classification, exact dedupe, counters.

Native expressions classify every row (``audio_only``, ``short_or_empty``,
``filtered_noisy``, ``kept``) in staged projections: the normalized text once,
then each feature once as its own column. Rows are then kept with a generator (a plain
filter would be pushed below the stages and recompute them). Dedupe is late: only
key and row number of the rows that pass leave the scan, the smallest row per key wins
(a hash aggregate; a hot duplicate key collapses map-side), and the texts are fetched for
the winners alone. The counters are one aggregate over the same narrow rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterkit.functions import text as T
from raterkit.operators.staging import keep_where
from raterkit.session import cut_lineage
from raterkit.operators.columns import (
    AUDIO_COL, EXAM_COL, MIN_LENGTH, QUESTION_ID_COL, SUBMISSION_COL, SUBMITTED_AT_COL, resolve_columns,
)

STATUS_AUDIO = "audio_only"
STATUS_SHORT = "short_or_empty"
STATUS_NOISY = "filtered_noisy"
STATUS_KEPT = "kept"

RECORD_COLUMNS = [
    "question", "question_id", "type", "category", "response", "response_type", "audio_url",
    "respondent_id", "submission_id", "exam_id", "submitted_at", "source_file", "row",
]


def _opt(df: DataFrame, name: str | None) -> Column:
    """Column if present, else NULL; empty string counts as missing."""
    if name is None or name not in df.columns:
        return F.lit(None).cast("string")
    return F.nullif(F.col(name).cast("string"), F.lit(""))


def classify(
    answers: DataFrame,
    *,
    response_col: str | None = None,
    question_col: str | None = None,
    type_col: str | None = None,
    respondent_col: str | None = None,
    anonymize: bool = False,
    min_length: int = MIN_LENGTH,
    salt: str | None = None,
    source_file: str | None = None,
    stopwords: Sequence[str] = T.INDONESIAN_STOPWORDS,
    min_hits: int = T.STOPWORD_MIN_HITS,
) -> DataFrame:
    """P3 + P4 + P5: canonical record columns plus ``status`` and ``dedupe_key`` (sha256 hex).

    The answer sheet needs a ``row`` ordinal (see ``raterkit.sources.answers``).
    """
    stage = _projected(answers, response_col, question_col, type_col, respondent_col, anonymize, salt)
    # Stage 2: each text feature once. The response is normalized, so it is already
    # stripped and single-spaced: its tokens are split on ' '.
    resp = F.col("_resp")
    renorm = T.renormalize(resp)
    stage = stage.withColumn("_renorm", renorm).withColumn("_tokens", F.split(resp, " "))
    toks = F.col("_tokens")
    stage = stage.select(
        "*",
        F.length(resp).alias("_len"),
        T.symbol_count(resp).alias("_symbols"),
        F.size(F.filter(toks, lambda x: F.length(x) == 1)).alias("_singles"),
        T.keyboard_mash(resp).alias("_mash"),
        T.token_count(F.col("_renorm")).alias("_words"),
        T.stopword_hits(F.col("_renorm"), stopwords, normalized=True, already=True).alias("_hits"),
    )
    n, n_tok = F.col("_len"), F.when(F.col("_len") == 0, F.lit(0)).otherwise(F.size(toks))
    gib = (
        (n > 0)
        & ((F.col("_symbols") / n > T.GIBBERISH_SYMBOL_RATIO) | F.col("_mash")
           | ((n_tok > 0) & (F.col("_singles") / n_tok > T.GIBBERISH_SINGLE_CHAR_RATIO)))
    )
    noisy = gib | ((resp != "") & (F.col("_hits") >= min_hits))
    status = (
        F.when(_is_audio(), F.lit(STATUS_AUDIO))
        .when((resp == "") | (F.col("_words") < min_length), F.lit(STATUS_SHORT))
        .when(noisy, F.lit(STATUS_NOISY))
        .otherwise(F.lit(STATUS_KEPT))
    )
    staged = _with_question(stage.withColumn("status", status))
    is_audio = F.col("status") == STATUS_AUDIO
    key = F.when(
        is_audio, F.concat(F.lit("audio:"), F.col("_audio"))
    ).otherwise(
        F.concat(F.lit("text:"), F.coalesce(F.col("question_id"), F.col("question"), F.lit("")), F.lit("|"), resp)
    )
    return staged.select("row", "status", *_record(is_audio, source_file), T.short_hash(key, 64).alias("dedupe_key"))


def _projected(answers: DataFrame, response_col: str | None, question_col: str | None, type_col: str | None,
               respondent_col: str | None, anonymize: bool, salt: str | None) -> DataFrame:
    """Stage 1: the columns of a record, with the normalized response (computed once)."""
    cols = resolve_columns(answers.columns, response_col, question_col, type_col, respondent_col)
    raw_resp = _opt(answers, cols["response"])
    raw_q = _opt(answers, cols["question"])
    raw_type = _opt(answers, cols["type"])
    raw_resp_id = _opt(answers, cols["respondent"])
    audio = _opt(answers, AUDIO_COL)
    qid = _opt(answers, QUESTION_ID_COL)

    return answers.select(
        F.col("row").cast("long").alias("row"),
        T.normalize_text(raw_resp).alias("_resp"),
        raw_q.alias("_raw_q"),
        qid.alias("question_id"),
        raw_type.alias("type"),
        audio.alias("_audio"),
        (T.anonymize_id(raw_resp_id, salt) if anonymize else F.lit(None).cast("string")).alias("respondent_id"),
        _opt(answers, SUBMISSION_COL).alias("submission_id"),
        _opt(answers, EXAM_COL).alias("exam_id"),
        _opt(answers, SUBMITTED_AT_COL).alias("submitted_at"),
    )


def _is_audio() -> Column:
    return (F.col("_resp") == "") & F.col("_audio").isNotNull()


def _with_question(stage: DataFrame) -> DataFrame:
    return stage.withColumn("question", F.when(F.col("_raw_q").isNotNull(), T.normalize_text(F.col("_raw_q"))))


def _record(is_audio: Column, source_file: str | None) -> list[Column]:
    """The record columns but ``row`` from a projected answer with its question."""
    return [
        F.col("question"), F.col("question_id"), F.col("type"),
        F.when(~is_audio, T.detect_category(F.coalesce(F.col("_raw_q"), F.lit("")))).alias("category"),
        F.when(~is_audio, F.col("_resp")).alias("response"),
        F.when(is_audio, F.lit("audio")).otherwise(F.lit("text")).alias("response_type"),
        F.when(is_audio, F.col("_audio")).alias("audio_url"),
        F.col("respondent_id"), F.col("submission_id"), F.col("exam_id"), F.col("submitted_at"),
        F.lit(source_file).cast("string").alias("source_file"),
    ]


def dedupe_first(df: DataFrame, key: str, order: str = "row", eligible: Column | None = None) -> DataFrame:
    """Keep the first row (smallest ``order``, unique among eligible rows) per ``key``.

    The smallest order per key is a hash aggregate over the key and a number; the rows are then
    those whose (key, order) is among them, so no text takes part in an aggregate. A key holding
    a third of all rows is reduced before its shuffle; the join on (key, order) has no hot key.
    """
    rows = df if eligible is None else keep_where(df, eligible)
    first = rows.groupBy(key).agg(F.min(order).alias(order))
    return rows.join(first, [key, order], "left_semi")


PASSED = (STATUS_AUDIO, STATUS_KEPT)


def narrow_of(answers: DataFrame, **kwargs) -> DataFrame:
    """``row, status, dedupe_key`` of every answer, written once: what dedupe and counters read."""
    return cut_lineage(classify(answers, **kwargs).select("row", "status", "dedupe_key"), "classified")


def deduplicated(answers: DataFrame, narrow: DataFrame, **kwargs) -> DataFrame:
    """The records of the first row of each key among those that pass. Texts are read, and
    normalized, for these rows only; no feature is computed again. Rows are known by ``row``."""
    passed = narrow.where(F.col("status").isin(*PASSED))
    first = passed.groupBy("dedupe_key").agg(F.min("row").alias("row")).select("row")
    source_file = kwargs.pop("source_file", None)
    own = {k: kwargs.get(k) for k in ("response_col", "question_col", "type_col", "respondent_col", "salt")}
    stage = _projected(answers.join(first, "row", "left_semi"), anonymize=kwargs.get("anonymize", False), **own)
    # audio or text as a column, so that the response is normalized once
    staged = _with_question(stage).withColumn("_audio_only", _is_audio())
    return staged.select(*_record(F.col("_audio_only"), source_file), "row").select(*RECORD_COLUMNS)


def clean_records(answers: DataFrame, *, dedupe: bool = False, **kwargs) -> DataFrame:
    """The cleaned records (kept text rows and audio rows), optionally deduplicated."""
    if dedupe:
        return deduplicated(answers, narrow_of(answers, **kwargs), **kwargs)
    return keep_where(classify(answers, **kwargs), F.col("status").isin(*PASSED)).select(*RECORD_COLUMNS)


def counters_of(classified: DataFrame, dedupe: bool = False) -> DataFrame:
    """total_rows, audio_only, short_or_empty, filtered_noisy, deduped, kept in one aggregate."""
    c = classified
    passed = F.col("status").isin(*PASSED)
    n_passed = F.sum(passed.cast("long"))
    kept = F.count_distinct(F.when(passed, F.col("dedupe_key"))) if dedupe else n_passed
    agg = c.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum((F.col("status") == STATUS_AUDIO).cast("long")).alias("audio_only"),
        F.sum((F.col("status") == STATUS_SHORT).cast("long")).alias("short_or_empty"),
        F.sum((F.col("status") == STATUS_NOISY).cast("long")).alias("filtered_noisy"),
        n_passed.alias("_passed"),
        kept.alias("kept"),
    )
    return agg.select(
        "total_rows",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("audio_only", "short_or_empty", "filtered_noisy")],
        (F.coalesce(F.col("_passed"), F.lit(0)) - F.col("kept")).cast("long").alias("deduped"),
        F.coalesce(F.col("kept"), F.lit(0)).cast("long").alias("kept"),
    )


def clean_counters(answers: DataFrame, *, dedupe: bool = False, **kwargs) -> DataFrame:
    """A11 from an answer sheet."""
    return counters_of(classify(answers, **kwargs).select("row", "status", "dedupe_key"), dedupe)
