"""Essay-question detection and deterministic per-question sampling.

All questions are sampled in one plan: (question, row) pairs are ranked inside
each question by sha256(seed|row) and cut at ``n``, first within shards of the
question, then among the shards' winners, so a question holding a third of all
rows is ranked by many tasks. Spark plans each cut as a ``WindowGroupLimit`` (at
most ``n`` rows per group leave a map task). The winners' texts are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterkit.functions import text as T
from raterkit.operators.columns import MIN_LENGTH
from raterkit.operators.staging import keep_where

ESSAY_TYPE_PATTERN = "essay|writing"
TOP_QUESTIONS = 3
PER_QUESTION = 50
SEED = 42
SHARDS = 64  # parts that the answers of one question are ranked in

# sample record columns (plus ``sample_rank``, the position in the question's sample)
SAMPLE_COLUMNS = [
    "respondent_id", "question", "question_id", "type", "category", "response",
    "submitted_at", "source_file", "row",
]


def _of_type(answers: DataFrame, qid_col: str, type_col: str, pattern: str) -> DataFrame:
    hit = F.coalesce(F.lower(F.col(type_col).cast("string")).rlike(pattern), F.lit(False))
    return answers.where(hit & F.col(qid_col).isNotNull())


def detect_questions_by_type(answers: DataFrame, qid_col: str = "questionId", type_col: str = "questionType",
                             pattern: str = ESSAY_TYPE_PATTERN) -> DataFrame:
    """Distinct question ids whose lower-cased type matches ``pattern``, with the row
    of their first appearance (the order questions are listed in)."""
    return (
        _of_type(answers, qid_col, type_col, pattern)
        .groupBy(F.col(qid_col).cast("string").alias("question_id"))
        .agg(F.min("row").alias("first_row"))
        .orderBy("first_row")  # question grain: a small range-partitioned sort
    )


def top_questions(answers: DataFrame, qid_col: str = "questionId", resp_col: str = "textResponse",
                  n: int = TOP_QUESTIONS) -> DataFrame:
    """The ``n`` questions with most non-blank answers (ties: smaller id first).
    Counting is a partial aggregate; only the per-question counts are ordered."""
    non_blank = F.coalesce(T.ustrip(F.col(resp_col).cast("string")) != "", F.lit(False))
    counts = (
        answers.where(non_blank & F.col(qid_col).isNotNull())
        .groupBy(F.col(qid_col).cast("string").alias("question_id"))
        .agg(F.count(F.lit(1)).alias("n_answers"))
    )
    order = [F.desc("n_answers"), F.asc("question_id")]
    # top-n first (a per-task top-k, then a merge of at most n rows per task); only the
    # n winners are numbered
    top = counts.orderBy(*order).limit(n)
    return top.withColumn("question_rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def detect_essay_questions(answers: DataFrame, qid_col: str = "questionId", type_col: str = "questionType",
                           resp_col: str = "textResponse", pattern: str = ESSAY_TYPE_PATTERN,
                           n: int = TOP_QUESTIONS) -> DataFrame:
    """P6 then P7: the type rule when it finds anything, else the most answered questions.
    Returns ``question_id``; the branch choice is one ``isEmpty`` probe (a limit-1 job)."""
    if type_col in answers.columns and qid_col in answers.columns:
        if not _of_type(answers, qid_col, type_col, pattern).isEmpty():  # the filter alone, one row
            return detect_questions_by_type(answers, qid_col, type_col, pattern).select("question_id")
    if qid_col in answers.columns and resp_col in answers.columns:
        return top_questions(answers, qid_col, resp_col, n).select("question_id")
    return answers.sparkSession.createDataFrame([], "question_id string")


def _valid_answers(answers: DataFrame, questions: DataFrame, qid_col: str, resp_col: str,
                   min_length: int) -> DataFrame:
    norm = T.normalize_text(F.col(resp_col))
    a = answers.withColumn("question_id", F.col(qid_col).cast("string")).withColumn("_norm", norm)
    a = a.join(questions.select("question_id"), "question_id", "left_semi")
    # the sampler counts the tokens of the once-normalized text
    return keep_where(a, T.token_count(F.col("_norm")) >= min_length)


def sample_per_question(
    answers: DataFrame,
    questions: DataFrame,
    *,
    n: int = PER_QUESTION,
    min_length: int = MIN_LENGTH,
    seed: int = SEED,
    salt: str | None = None,
    qid_col: str = "questionId",
    qtext_col: str = "questionText",
    resp_col: str = "textResponse",
    type_col: str = "questionType",
) -> DataFrame:
    """W2 + P5: up to ``n`` answers per question among those with >= ``min_length`` words,
    chosen by the rank of sha256(seed|row); ``sample_rank`` is the position in the sample.

    Same size guarantee as a seeded random draw without replacement (min(n, valid)),
    and stable under re-runs and repartitioning.
    """
    cols = set(answers.columns)
    narrow = _valid_answers(answers, questions, qid_col, resp_col, min_length).select(
        "question_id", "row",
        F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("row").cast("string")), 256).alias("_order"),
        F.pmod(F.xxhash64("row"), F.lit(SHARDS)).alias("_shard"),
    )
    # ranks of narrow rows, first within shards of a question, then among the shards' winners
    shard = Window.partitionBy("question_id", "_shard").orderBy("_order", "row")
    question = Window.partitionBy("question_id").orderBy("_order", "row")
    winners = narrow.withColumn("_r", F.row_number().over(shard)).where(F.col("_r") <= n)
    winners = winners.withColumn("sample_rank", F.row_number().over(question).cast("long")).where(F.col("sample_rank") <= n)
    winners = winners.select(F.col("question_id").alias("_question"), F.col("row").alias("_row"), "sample_rank")
    own = answers.withColumn("question_id", F.col(qid_col).cast("string"))
    ranked = own.join(winners, (own["question_id"] == winners["_question"]) & (own["row"] == winners["_row"]))
    ranked = ranked.withColumn("_norm", T.normalize_text(F.col(resp_col)))
    respondent = "nim" if "nim" in cols else "nama" if "nama" in cols else None
    resp_raw = F.nullif(F.col(respondent).cast("string"), F.lit("")) if respondent else F.lit(None).cast("string")
    qtext = T.normalize_text(F.col(qtext_col)) if qtext_col in cols else F.lit(None).cast("string")
    out = ranked.select(
        T.anonymize_id(resp_raw, salt).alias("respondent_id"),
        qtext.alias("question"),
        F.col("question_id"),
        (F.col(type_col).cast("string") if type_col in cols else F.lit(None).cast("string")).alias("type"),
        T.detect_category(qtext).alias("category"),
        F.col("_norm").alias("response"),
        (F.col("submittedAt").cast("string") if "submittedAt" in cols else F.lit(None).cast("string")).alias("submitted_at"),
        F.lit(None).cast("string").alias("source_file"),
        F.col("row").cast("long").alias("row"),
        F.col("sample_rank"),
    )
    return out.select(*SAMPLE_COLUMNS, "sample_rank")


def sampling_summary(answers: DataFrame, questions: DataFrame, *, n: int = PER_QUESTION,
                     min_length: int = MIN_LENGTH, qid_col: str = "questionId",
                     resp_col: str = "textResponse") -> DataFrame:
    """Per question, valid answers and sample size (= min(n, valid))."""
    valid = _valid_answers(answers, questions, qid_col, resp_col, min_length)
    return valid.groupBy("question_id").agg(F.count(F.lit(1)).alias("total_valid")).select(
        "question_id", "total_valid", F.least(F.col("total_valid"), F.lit(n)).cast("long").alias("sampled")
    )


def sample_file_name(question_id: F.Column) -> F.Column:
    """Name of a question's sample file; selection orders by it as a file listing would."""
    return F.concat(F.lit("question_"), question_id, F.lit("_samples.jsonl"))


def select_samples(samples: DataFrame, names: Sequence[str] | None = None, max_questions: int | None = None,
                   per_question: int | None = None) -> DataFrame:
    """Keep sample files by name, then the first ``max_questions`` files (by name),
    then the first ``per_question`` samples of each file (by ``sample_rank``)."""
    s = samples.withColumn("sample_file", sample_file_name(F.col("question_id")))
    if names:
        s = s.where(F.col("sample_file").isin(list(names)))
    if max_questions is not None:
        first_files = s.select("sample_file").distinct().orderBy("sample_file").limit(max_questions)
        s = s.join(first_files, "sample_file", "left_semi")
    if per_question is not None:
        s = s.where(F.col("sample_rank") <= per_question)
    return s
