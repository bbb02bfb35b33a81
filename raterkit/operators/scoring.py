"""Scoring requests: plan, resume, score, records.

The plan is samples x models x runs built with ``explode`` over literal
arrays (no join, no driver loop). Resume is a null-safe ``left_anti`` join
against completed responses. Scoring is either the constant dry run (a
literal, JVM-side) or a user scorer run per Arrow batch in ``mapInPandas``;
a failing call is recorded as ``ERROR: ...`` text, like any other output.

A scorer call is not idempotent and Spark may retry a task: write responses
once (``raterkit.sources.sinks.write_responses``) and resume with
``pending_requests`` against what was written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterkit.functions.parse import DRY_RUN_TEXT, ERROR_PREFIX, parse_scores
from raterkit.functions.text import path_safe
from raterkit.session import cut_lineage

# ---------------------------------------------------------------------------
# Fixed value: the grading instruction placed before every question/response.
# ---------------------------------------------------------------------------
PROMPT_HEADER = (
    "You are an objective, rubric-based grader.\n"
    "INSTRUCTIONS: Output EXACTLY one JSON object and NOTHING else. Do NOT include explanations, reasoning, "
    "or any additional text. No bullet lists, no code fences, no commentary.\n\n"
    "OUTPUT SCHEMA: {\"grammar\": int, \"lexical\": int, \"coherence\": int, \"task\": int }\n"
    "- Each value MUST be an integer between 0 and 9 (inclusive). Round to the nearest integer if needed.\n\n"
    "SCORING BRIEFS (one line each):\n"
    "- grammar: accuracy and range of grammar, spelling, punctuation.\n"
    "- lexical: vocabulary range and word choice appropriateness.\n"
    "- coherence: organization, logic, and flow of ideas.\n"
    "- task: how well the response addresses the prompt and fulfills requirements.\n\n"
    "RULES: If uncertain, choose the closest integer. If the response cannot be scored, set all fields to null. "
    "Do NOT reveal chain-of-thought. Keep the JSON compact (no extra spaces or newlines).\n\n"
)
DEFAULT_RUNS = 3
# ---------------------------------------------------------------------------

RESPONSE_COLUMNS = ["model", "run", "sample_row", "question_id", "respondent_id", "response", "raw", "parsed"]


def _text_or(df: DataFrame, name: str) -> Column:
    """Python f-string rendering of ``sample.get(name, '')``: absent -> '', NULL -> 'None'."""
    if name not in df.columns:
        return F.lit("")
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def build_prompt(samples: DataFrame, question: str = "question", response: str = "response") -> Column:
    """The grading prompt for each sample."""
    return F.concat(
        F.lit(PROMPT_HEADER), F.lit("Question: "), _text_or(samples, question),
        F.lit("\n\nResponse: "), _text_or(samples, response), F.lit("\n"),
    )


def _samples(samples: DataFrame, *more: str) -> DataFrame:
    """Sample columns of a request, and ``more``. ``stem`` names the output folder: the sample's source file
    stem, else ``question_<id>``."""
    cols = set(samples.columns)

    def text(name: str) -> Column:
        return (F.col(name).cast("string") if name in cols else F.lit(None).cast("string")).alias(name)

    src = F.col("source_file").cast("string") if "source_file" in cols else F.lit(None).cast("string")
    file_stem = F.regexp_extract(src, r"([^/\\]*?)(\.[^./\\]*)?$", 1)
    stem = F.when(F.coalesce(src, F.lit("")) != "", file_stem).otherwise(
        F.concat(F.lit("question_"), F.coalesce(F.col("question_id").cast("string"), F.lit("")))
    )
    return samples.select(
        F.col("row").alias("sample_row") if "row" in cols else F.lit(None).cast("long").alias("sample_row"),
        text("question_id"), text("respondent_id"), text("question"), text("response"),
        build_prompt(samples).alias("prompt"),
        stem.alias("stem"),
        *more,
    )


def _requests(models: Sequence[str], runs: int) -> Column:
    """All (model, run) of a job: an array of parameters, not data."""
    return F.array(*[F.struct(F.lit(m).alias("model"), F.lit(r).alias("run")) for m in models for r in range(1, int(runs) + 1)])


def _exploded(base: DataFrame, requests: Column) -> DataFrame:
    out = base.withColumn("_request", F.explode(requests)).withColumns({"model": F.col("_request.model"), "run": F.col("_request.run")})
    return out.drop("_request").withColumn("model_safe", path_safe(F.col("model")))


def score_plan(samples: DataFrame, models: Sequence[str], runs: int = DEFAULT_RUNS) -> DataFrame:
    """J7 + T9 + T10: one request per (sample, model, run), runs numbered 1..runs."""
    return _exploded(_samples(samples), _requests(models, runs))


# samples with completed requests (narrow keys) that may be broadcast: some 100 bytes each
SMALL_KEYS = 100_000


def pending_plan(samples: DataFrame, models: Sequence[str], runs: int, done: DataFrame | None,
                 small: int = SMALL_KEYS) -> DataFrame:
    """J6 + J7: the requests of a job that are not among the completed responses.

    The completed (model, run) pairs of a sample are one short set (at most models x runs), found
    over narrow keys. Up to ``small`` of them are broadcast to the samples, whose texts
    then stay where they are. Beyond that, the samples' keys are joined first, and the texts only to
    those with requests left: by broadcast if these are few. Prompts are built last.
    """
    if done is None:
        return _exploded(_samples(samples), _requests(models, runs))
    k = resume_keys(done).where(F.col("_k_model").isin(list(models)) & F.col("_k_run").between(1, int(runs)))
    finished = cut_lineage(k.groupBy("_k_row", "_k_resp").agg(
        F.collect_set(F.struct(F.col("_k_model").alias("model"), F.col("_k_run").alias("run"))).alias("_finished")
    ), "finished")
    every = _requests(models, runs)
    left = F.when(F.col("_finished").isNull(), every).otherwise(F.array_except(every, F.col("_finished")))
    row = _row_key(F.col("row")) if "row" in samples.columns else F.lit(-1).cast("long")
    respondent = F.col("respondent_id") if "respondent_id" in samples.columns else F.lit(None)
    keyed = samples.withColumns({"_row": row, "_resp": respondent.cast("string")})
    same = (F.col("_row") == F.col("_k_row")) & F.col("_resp").eqNullSafe(F.col("_k_resp"))
    if _few(finished, small):
        todo = keyed.join(F.broadcast(finished), same, "left").withColumn("_todo", left)
    else:
        keys = keyed.select("_row", "_resp").distinct().join(finished, same, "left")
        keys = keys.select(F.col("_row").alias("_k_row"), F.col("_resp").alias("_k_resp"), left.alias("_todo"))
        keys = cut_lineage(keys.where(F.size("_todo") > 0), "pending")
        todo = keyed.join(F.broadcast(keys) if _few(keys, small) else keys, same)
    return _exploded(_samples(todo, "_todo"), F.col("_todo")).drop("_todo")


def _few(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


def _row_key(c: Column) -> Column:
    """``int(row or -1)``: NULL and 0 both become -1."""
    v = c.cast("string").try_cast("double").try_cast("long")
    return F.when(F.coalesce(v, F.lit(0)) == 0, F.lit(-1).cast("long")).otherwise(v)


def resume_keys(done: DataFrame) -> DataFrame:
    """The resume key of completed responses: (model, run or 0, sample_row or -1, respondent_id)."""
    return done.select(
        F.col("model").alias("_k_model"),
        F.coalesce(F.col("run").cast("string").try_cast("double").try_cast("int"), F.lit(0)).alias("_k_run"),
        _row_key(F.col("sample_row")).alias("_k_row"),
        F.col("respondent_id").cast("string").alias("_k_resp"),
    )


def pending_requests(plan: DataFrame, done: DataFrame | None) -> DataFrame:
    """Requests of ``plan`` whose key is not among ``done``; NULL respondent matches NULL."""
    if done is None:
        return plan
    k = resume_keys(done)
    cond = [
        plan["model"] == k["_k_model"],
        plan["run"] == k["_k_run"],
        _row_key(plan["sample_row"]) == k["_k_row"],
        plan["respondent_id"].eqNullSafe(k["_k_resp"]),
    ]
    return plan.join(k, cond, "left_anti")


Scorer = Callable[[str, str], str]
BatchScorer = Callable[[pd.Series, pd.Series], Sequence[str]]


def score(plan: DataFrame, scorer: Scorer | None = None, *, dry_run: bool = False,
          scorer_factory: Callable[[], Scorer] | None = None,
          batch_scorer: BatchScorer | None = None) -> DataFrame:
    """B2: add ``raw`` (the scorer's text) to every request.

    ``dry_run`` yields the constant all-7 object without calling anything. A scorer is
    ``(prompt, model) -> text``; ``scorer_factory`` builds one per partition (e.g. a client);
    a ``batch_scorer`` takes a whole Arrow batch ``(prompts, models) -> texts``. An exception
    becomes ``ERROR: <message>`` (for a failing batch, on each of its rows).
    """
    if dry_run:
        return plan.withColumn("raw", F.lit(DRY_RUN_TEXT))
    if scorer is None and scorer_factory is None and batch_scorer is None:
        raise ValueError("pass a scorer, a scorer_factory, a batch_scorer, or dry_run=True")
    schema = T.StructType(plan.schema.fields + [T.StructField("raw", T.StringType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if batch_scorer is not None:
            for pdf in batches:
                try:
                    out = list(batch_scorer(pdf["prompt"], pdf["model"]))
                except Exception as e:  # noqa: BLE001 - recorded as the response text
                    out = [f"{ERROR_PREFIX}{e}"] * len(pdf)
                yield pdf.assign(raw=out)
            return
        call = scorer_factory() if scorer_factory is not None else scorer
        for pdf in batches:
            out = []
            for prompt, model in zip(pdf["prompt"], pdf["model"]):
                try:
                    out.append(call(prompt, model))
                except Exception as e:  # noqa: BLE001 - recorded as the response text
                    out.append(f"{ERROR_PREFIX}{e}")
            yield pdf.assign(raw=out)

    return plan.mapInPandas(run, schema)


def response_records(scored: DataFrame) -> DataFrame:
    """Checkpoint-shaped records with the parsed scores."""
    return scored.select(
        "model", "run", "sample_row", "question_id", "respondent_id", "response", "raw",
        parse_scores(F.col("raw")).alias("parsed"),
        *[c for c in ("stem", "model_safe") if c in scored.columns],
        *[F.col("question").alias("question_text") for c in scored.columns if c == "question"],  # names a folder without an id
    )
