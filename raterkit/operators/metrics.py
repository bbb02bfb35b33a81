"""Essay- and model-grain metrics and routing.

All aggregations are ``groupBy`` with partial (map-side) aggregation, so a hot
model or essay is pre-reduced before the shuffle. Windows run only on tables
already aggregated to model grain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterkit.functions.parse import is_error
from raterkit.operators.icc import with_counts
from raterkit.session import cut_lineage

AUTO_APPROVE = "Auto-Approve"
FLAGGED = "Flagged for Review"
HITL_STATUSES = [AUTO_APPROVE, FLAGGED]
# defaults of the routing thresholds
CV_THRESHOLD = 0.15
RANGE_THRESHOLD = 2.0
# cv is compared after rounding to this many places, so the comparison does not
# depend on the summation order of the standard deviation (cv = 0.15 exactly stays 0.15)
CV_COMPARE_DIGITS = 12

ESSAY_KEYS = ["model", "essay_id"]
ESSAY_ATTRIBUTES = ["respondent_id", "question_id", "sample_row", "prompt_category", "prompt_question"]


ESSAY_OUTPUT = [
    "model", "essay_id", "respondent_id", "question_id", "sample_row", "prompt_category", "prompt_question",
    "mean_total", "sd_total", "min_total", "max_total", "n_runs", "range_total", "cv_total",
]


def collapse_duplicate_runs(aligned: DataFrame) -> DataFrame:
    """One row per (model, essay, run): the mean total of repeated responses of a run."""
    return aligned.groupBy(*ESSAY_KEYS, "run").agg(F.avg("total_score").alias("total_score"))


def attach_prompts(essays: DataFrame, prompts: DataFrame) -> DataFrame:
    """Prompt category and question from the question-grain prompt table (left join on the
    question; an unmapped question gets category 'unknown'). The table has one row per
    question; it is written first, so that Spark knows its size and broadcasts a small one."""
    p = cut_lineage(prompts.select("question_id", "prompt_category", "prompt_question"), "prompts")
    out = essays.drop("prompt_category", "prompt_question").join(p, "question_id", "left")
    out = out.withColumn("prompt_category", F.coalesce(F.col("prompt_category"), F.lit("unknown")))
    return out.select(*[c for c in ESSAY_OUTPUT if c in out.columns])


def spread(aggregated: DataFrame) -> DataFrame:
    """Columns of A1 from ``mean_total, _sd, min_total, max_total, n_runs``: ``sd`` and ``range`` are 0
    when undefined, ``cv = sd / mean`` is 0 when the mean is 0 or NULL."""
    sd = F.coalesce(F.col("_sd"), F.lit(0.0))
    return aggregated.withColumns({
        "sd_total": sd,
        "range_total": F.coalesce(F.col("max_total") - F.col("min_total"), F.lit(0.0)),
        "cv_total": F.when(F.col("mean_total").isNull() | (F.col("mean_total") == 0), F.lit(0.0)).otherwise(sd / F.col("mean_total")),
    }).drop("_sd")


def _score_state() -> list[F.Column]:
    return [
        F.avg("total_score").alias("mean_total"),
        F.stddev_samp("total_score").alias("_sd"),
        F.min("total_score").alias("min_total"),
        F.max("total_score").alias("max_total"),
        F.count("total_score").alias("n_runs"),
    ]


def essay_scores(aligned: DataFrame, dedupe_runs: bool = False) -> DataFrame:
    """A1 without the attributes: per (model, essay) mean/sample-sd/min/max/count of total score.

    Essays without any scored run are kept (mean NULL, spread 0).
    ``dedupe_runs=True`` first collapses repeated responses of one run (as the ICC does);
    the default counts every response, as the reference does. Only fixed-width buffers, so a
    hash aggregate.
    """
    if dedupe_runs:
        aligned = collapse_duplicate_runs(aligned)
    agg = spread(aligned.groupBy(*ESSAY_KEYS).agg(*_score_state()))
    return agg.select(*[c for c in ESSAY_OUTPUT if c in agg.columns])


# --- ids of an essay, read back from its key

ID_PARTS = ["respondent_id", "question_id", "sample_row"]
_START = 10**10  # places of (run, start, length) in one decimal number


def id_state(columns: list[str]) -> list[F.Column]:
    """Fixed-width aggregates from which ``with_ids`` reads an essay's ids: whether an id has a value
    in any response and, where an id holds the separator itself (so that the key can be split in
    more than one way), run, start and length of the value of the first run."""
    own = [c for c in ID_PARTS if c in columns]
    text = {c: F.coalesce(F.col(c), F.lit("")) if c in own else F.lit("") for c in ID_PARTS}
    odd = F.lit(False)
    for c in own:
        odd = odd | text[c].contains("|")
    length = {c: F.length(text[c]) for c in ID_PARTS}
    start = {
        "respondent_id": F.lit(0),
        "question_id": length["respondent_id"] + 1,
        "sample_row": F.length("essay_id") - length["sample_row"],
    }
    out = []
    for c in own:
        run = (F.coalesce(F.col("run"), F.lit(0)).cast("decimal(12,0)") + F.lit(2**31)).cast("decimal(12,0)")
        place = run * F.lit(_START).cast("decimal(11,0)") + start[c]
        place = (place * F.lit(_START).cast("decimal(11,0)") + length[c]).cast("decimal(38,0)")
        out.append(F.max(F.col(c).isNotNull()).alias(f"_has_{c}"))
        out.append(F.min(F.when(odd & F.col(c).isNotNull(), place)).alias(f"_at_{c}"))
    return out


def merged_id_state(columns: list[str]) -> list[F.Column]:
    """``id_state`` of groups of rows that hold states already."""
    return [(F.max if c.startswith("_has_") else F.min)(c).alias(c) for c in columns if c.startswith(("_has_", "_at_"))]


def with_ids(essays: DataFrame) -> DataFrame:
    """The id columns from the essay key ``respondent|question|row`` and ``id_state``.

    An id is its first value that is not null, by run. As the key is made of the ids (NULL as
    ''), that is the part of the key, or NULL if no response has a value; keys that can be split in
    several ways use the place found by ``id_state`` (equal runs: the one that starts and ends first).
    """
    parts = F.split("essay_id", r"\|", -1)
    ids = {}
    for i, c in enumerate(ID_PARTS):
        if f"_has_{c}" not in essays.columns:
            continue
        at = F.col(f"_at_{c}")
        start = F.expr(f"cast((`_at_{c}` % cast('{_START**2}' as decimal(21,0))) div {_START}L as int)")
        length = F.expr(f"cast(`_at_{c}` % {_START}L as int)")
        value = F.when(at.isNull(), F.get(parts, i)).otherwise(F.substring("essay_id", start + 1, length))
        ids[c] = F.when(F.col(f"_has_{c}"), value)
    return essays.withColumns(ids).drop(*[x + c for c in ids for x in ("_has_", "_at_")])


def prompt_attributes(aligned: DataFrame) -> DataFrame:
    """Prompt columns per (model, essay) where the responses carry them: for each the first value that
    is not null, by run (equal runs: the smaller value)."""
    names = [c for c in ESSAY_ATTRIBUTES if c in aligned.columns and c not in ID_PARTS]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("run", c))).alias(c) for c in names]
    return aligned.groupBy(*ESSAY_KEYS).agg(*first)


def essay_metrics(aligned: DataFrame, dedupe_runs: bool = False) -> DataFrame:
    """A1: ``essay_scores`` with the essay's attributes; one row per (model, essay).

    One hash aggregate over the responses: the ids come from the essay key (``with_ids``), which must
    be made of them as ``align.essay_id`` does. Only prompt columns that the responses carry
    themselves, and may differ in, take an aggregate of their own; prompts from the prompt
    table are attached to the essays (``attach_prompts``).
    """
    if dedupe_runs:
        runs = aligned.groupBy(*ESSAY_KEYS, "run").agg(F.avg("total_score").alias("total_score"), *id_state(aligned.columns))
        agg = runs.groupBy(*ESSAY_KEYS).agg(*_score_state(), *merged_id_state(runs.columns))
    else:
        agg = aligned.groupBy(*ESSAY_KEYS).agg(*_score_state(), *id_state(aligned.columns))
    essays = with_ids(spread(agg))
    if any(c in aligned.columns for c in ESSAY_ATTRIBUTES if c not in ID_PARTS):
        essays = essays.join(prompt_attributes(aligned), ESSAY_KEYS)
    return essays.select(*[c for c in ESSAY_OUTPUT if c in essays.columns])


def hitl_status(cv: F.Column, rng: F.Column, cv_threshold: float = CV_THRESHOLD,
                range_threshold: float = RANGE_THRESHOLD) -> F.Column:
    """M4: Auto-Approve iff cv < cv_threshold and range <= range_threshold."""
    ok = (F.round(cv, CV_COMPARE_DIGITS) < F.lit(cv_threshold)) & (rng <= F.lit(range_threshold))
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(AUTO_APPROVE)).otherwise(F.lit(FLAGGED))


def apply_hitl(essays: DataFrame, cv_threshold: float = CV_THRESHOLD,
               range_threshold: float = RANGE_THRESHOLD, unscored: str = "approve") -> DataFrame:
    """M4 on the essay table. ``unscored``: 'approve' (reference behaviour: an essay with no
    scored run has zero spread and is approved), 'flag', or 'exclude'."""
    status = hitl_status(F.col("cv_total"), F.col("range_total"), cv_threshold, range_threshold)
    if unscored == "flag":
        status = F.when(F.col("n_runs") == 0, F.lit(FLAGGED)).otherwise(status)
    out = essays
    if unscored == "exclude":
        out = out.where(F.col("n_runs") > 0)
    return out.withColumn("hitl_status", status)


def hitl_distribution(routed: DataFrame) -> DataFrame:
    """A6 + J4: count and percentage per (model, status); the per-model total is a window
    over the already aggregated (model x status) rows."""
    dist = routed.groupBy("model", "hitl_status").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("model"))
    return dist.withColumn("pct", F.col("count") * 100.0 / total)


def model_summary_base(routed: DataFrame) -> DataFrame:
    """A7 + A8 + T11 in one aggregate: per model essays (unscored included), mean and sample sd
    of essay means, mean sd, mean range, mean cv, and the share of each routing status in
    percent as ``auto-approve`` and ``flagged_for_review`` (NULL where it never occurs)."""
    shares = [
        (F.sum(F.when(F.col("hitl_status") == s, 100.0)) / F.count(F.lit(1))).alias(s.replace(" ", "_").lower())
        for s in HITL_STATUSES
    ]
    return routed.groupBy("model").agg(
        F.count("essay_id").alias("n_essays"),
        F.avg("mean_total").alias("mean_total"),
        F.stddev_samp("mean_total").alias("sd_total"),
        F.avg("sd_total").alias("mean_sd"),
        F.avg("range_total").alias("mean_range"),
        F.avg("cv_total").alias("mean_cv"),
        *shares,
    )


def model_summary(routed: DataFrame, icc: DataFrame) -> DataFrame:
    """Summary LEFT JOIN icc at model grain (tiny sides); every model with an essay appears."""
    joined = with_counts(model_summary_base(routed).join(icc, "model", "left"))
    shares = [s.replace(" ", "_").lower() for s in HITL_STATUSES]
    return joined.select(*[F.col(f"`{c}`") for c in joined.columns if c not in shares], *[F.col(f"`{c}`") for c in shares])


SCORE_MIN, SCORE_MAX = 0, 9


def parse_failure_rate(aligned: DataFrame) -> DataFrame:
    """R5/R6 at essay grain: submitted essays, essays with a score, failures and their share,
    plus error responses (scorer exceptions) and responses with a score outside 0-9
    (never clamped) at response grain."""
    fields = [c for c in ("grammar", "lexical", "coherence", "task") if c in aligned.columns]
    outside = None
    for c in fields:
        cond = (F.col(c) < SCORE_MIN) | (F.col(c) > SCORE_MAX)
        outside = cond if outside is None else outside | cond
    outside = F.coalesce(outside, F.lit(False)) if outside is not None else F.lit(False)
    per_essay = aligned.groupBy("model", "essay_id").agg(
        F.count("total_score").alias("_scored"),
        F.count(F.lit(1)).alias("_responses"),
        F.sum(outside.cast("int")).alias("_outside"),
        F.sum((F.col("is_error") if "is_error" in aligned.columns else is_error(F.col("raw"))).cast("int")).alias("_errors"),
    )
    return per_essay.groupBy("model").agg(
        F.count(F.lit(1)).alias("submitted"),
        F.sum((F.col("_scored") > 0).cast("long")).alias("valid"),
        F.sum((F.col("_scored") == 0).cast("long")).alias("failed"),
        (F.sum((F.col("_scored") == 0).cast("long")) * 100.0 / F.count(F.lit(1))).alias("failed_pct"),
        F.sum("_responses").alias("responses"),
        F.sum("_errors").cast("long").alias("error_responses"),
        F.sum("_outside").cast("long").alias("out_of_range_responses"),
    )


def scored_only_summary(routed: DataFrame) -> DataFrame:
    """Spread and routing over scored essays only (the reference's summary counts an
    unscored essay as zero spread and approved; these columns leave such essays out)."""
    s = routed.where(F.col("n_runs") > 0)
    return s.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.avg("sd_total").alias("mean_sd_scored"),
        F.avg("range_total").alias("mean_range_scored"),
        F.avg("cv_total").alias("mean_cv_scored"),
        (F.avg((F.col("hitl_status") == AUTO_APPROVE).cast("double")) * 100.0).alias("auto_approve_scored_pct"),
    )
