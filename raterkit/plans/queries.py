"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query runs over whole tables. Double columns are rounded to 9 places so
that results compare exactly with the DuckDB oracle (``raterkit.plans.oracle``)
regardless of summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterkit.functions import parse as P
from raterkit.functions import text as TX
from raterkit.operators import bias, metrics
from raterkit.operators import clean as CL
from raterkit.operators import report as RP
from raterkit.operators import sample as SA
from raterkit.operators import scoring as SC
from raterkit.operators.align import align_inputs, typed_responses
from raterkit.plans import responses as rsp
from raterkit.plans.analysis import Analysis, testdata_analysis
from raterkit.plans.tables import table
from raterkit.session import cut_lineage, scratch_path
from raterkit.sources import jsonl as JS
from raterkit.sources import sinks as SK
from raterkit.sources.answers import with_row_ordinal

DIGITS = 9
QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    """Register a query function under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn

    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (for exact comparison with the oracle)."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# --------------------------------------------------------------------------- parsing

@query("parse_strict")
def q_parse_strict(spark, sf_dir):
    r = rsp.raw_responses(spark, sf_dir)
    s = P.strict_scores("raw")
    return r.select(
        "l_orderkey", "l_linenumber", "model",
        P.strict_match("raw").alias("strict_match"),
        *[s.getField(k).alias(f"strict_{k}") for k in P.SCORE_FIELDS],
    )


@query("parse_fallback")
def q_parse_fallback(spark, sf_dir):
    r = rsp.raw_responses(spark, sf_dir)
    d = P.digit_scores("raw")
    return r.select(
        "l_orderkey", "l_linenumber", "model",
        P.parse_method("raw").alias("parse_method"),
        F.size(P.digit_tokens("raw")).cast("long").alias("n_digits"),
        *[d.getField(k).alias(f"digit_{k}") for k in P.SCORE_FIELDS],
    )


@query("score_extract")
def q_score_extract(spark, sf_dir):
    r = P.with_scores(rsp.responses(spark, sf_dir))
    return rounded(r.select("l_orderkey", "l_linenumber", "model", *P.SCORE_FIELDS))


@query("total_score")
def q_total_score(spark, sf_dir):
    r = P.with_scores(rsp.responses(spark, sf_dir))
    return rounded(r.select("l_orderkey", "l_linenumber", "model", "run", "total_score",
                            P.is_error("raw").alias("is_error")))


@query("parse_failure_rate")
def q_parse_failure_rate(spark, sf_dir):
    return rounded(metrics.parse_failure_rate(testdata_analysis(spark, sf_dir).aligned))


# --------------------------------------------------------------------------- essays, routing, summary

@query("essay_identity")
def q_essay_identity(spark, sf_dir):
    """Response-grain alignment with the prompt map joined per response."""
    from raterkit.operators.align import sample_map
    a = align_inputs(rsp.responses(spark, sf_dir), sample_map(rsp.part_samples(spark, sf_dir)),
                     source="samples.category")
    return a.select("l_orderkey", "l_linenumber", "model", "run", "essay_id", "sample_row",
                    "prompt_category", "prompt_question")


@query("category_source")
def q_category_source(spark, sf_dir):
    return testdata_analysis(spark, sf_dir).category_source


@query("essay_metrics")
def q_essay_metrics(spark, sf_dir):
    return rounded(testdata_analysis(spark, sf_dir).essays)


@query("hitl_routing")
def q_hitl_routing(spark, sf_dir):
    return rounded(testdata_analysis(spark, sf_dir).routed)


@query("hitl_distribution")
def q_hitl_distribution(spark, sf_dir):
    return rounded(testdata_analysis(spark, sf_dir).distribution)


@query("icc_by_model")
def q_icc_by_model(spark, sf_dir):
    return rounded(testdata_analysis(spark, sf_dir).materialize().icc)


@query("model_summary")
def q_model_summary(spark, sf_dir):
    return rounded(testdata_analysis(spark, sf_dir).materialize().summary)


# --------------------------------------------------------------------------- bias

# The part types of the test tables: the columns asked of the topic matrix.
TOPICS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

@query("severity_pairs")
def q_severity_pairs(spark, sf_dir):
    a = testdata_analysis(spark, sf_dir)
    return rounded(bias.essay_pairs(a.scores, names=a.pair_names()))


@query("severity_ttest")
def q_severity_ttest(spark, sf_dir):
    t = testdata_analysis(spark, sf_dir).ttest
    return rounded(t.select("model_1", "model_2", "tstat", "n_pairs", "degenerate"))


@query("severity_pvalue")
def q_severity_pvalue(spark, sf_dir):
    t = testdata_analysis(spark, sf_dir).ttest
    return t.select("model_1", "model_2", "n_pairs", F.format_string("%.9e", "pvalue").alias("pvalue"))


@query("bland_altman")
def q_bland_altman(spark, sf_dir):
    return rounded(testdata_analysis(spark, sf_dir).bland_altman)


@query("significance")
def q_significance(spark, sf_dir):
    s = bias.significance(testdata_analysis(spark, sf_dir).ttest)
    return rounded(s.select("model_1", "model_2", "tstat", "n_pairs", "significant", "direction",
                            "model_1_short", "model_2_short"))


@query("topic_bias")
def q_topic_bias(spark, sf_dir):
    return rounded(testdata_analysis(spark, sf_dir).topics)


@query("topic_delta")
def q_topic_delta(spark, sf_dir):
    return rounded(bias.topic_delta(testdata_analysis(spark, sf_dir).topics))


@query("topic_matrix")
def q_topic_matrix(spark, sf_dir):
    return rounded(bias.topic_matrix(testdata_analysis(spark, sf_dir).topics, TOPICS))


@query("category_question_list")
def q_category_question_list(spark, sf_dir):
    """A5 in long form: one row per category and distinct question."""
    return bias.category_question_list(testdata_analysis(spark, sf_dir).essays)


@query("topic_range")
def q_topic_range(spark, sf_dir):
    return rounded(bias.topic_range(bias.topic_delta(testdata_analysis(spark, sf_dir).topics)))


@query("category_questions")
def q_category_questions(spark, sf_dir):
    return bias.category_questions(testdata_analysis(spark, sf_dir).essays)


# --------------------------------------------------------------------------- text functions


# A French stop-word list: the test documents hold no Indonesian, so the language
# filter is exercised with French (the list is a parameter of the operator).
FRENCH_STOPWORDS = [
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en",
    "que", "qui", "dans", "pour", "sur", "avec", "est", "pas", "au", "aux",
]
SAMPLE_N = 20


def _texts(spark, sf_dir):
    """Whole texts of documents, conversation turns and web pages, keyed (src, id, id2)."""
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"),
                                                  F.lit(0).cast("long").alias("id2"), F.col("text"))
    c = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("src"), F.col("conv_id").alias("id"),
                                                      F.col("turn").alias("id2"), F.col("text"))
    p = table(spark, sf_dir, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"),
                                              F.lit(0).cast("long").alias("id2"), F.col("html").alias("text"))
    return d.unionByName(c).unionByName(p)


@query("normalize_text")
def q_normalize_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("src", "id", "id2", TX.normalize_text("text").alias("normalized"))


@query("word_count")
def q_word_count(spark, sf_dir):
    return _texts(spark, sf_dir).select("src", "id", "id2", TX.word_count("text").cast("long").alias("word_count"))


@query("gibberish")
def q_gibberish(spark, sf_dir):
    return _texts(spark, sf_dir).select("src", "id", "id2", TX.is_gibberish("text").alias("is_gibberish"))


@query("stopword_language")
def q_stopword_language(spark, sf_dir):
    t = _texts(spark, sf_dir)
    return t.select("src", "id", "id2",
                    TX.stopword_hits("text", FRENCH_STOPWORDS).cast("long").alias("stopword_hits"),
                    TX.contains_stopword_language("text", FRENCH_STOPWORDS).alias("is_stopword_language"))


@query("noisy_text")
def q_noisy_text(spark, sf_dir):
    t = _texts(spark, sf_dir).select("src", "id", "id2", TX.normalize_text("text").alias("norm"))
    return t.select("src", "id", "id2", TX.is_noisy_text("norm", FRENCH_STOPWORDS, normalized=True).alias("is_noisy"))


@query("detect_category")
def q_detect_category(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("src"), F.col("item_id").alias("id"), "text")
    return d.unionByName(b).select("src", "id", TX.detect_category("text").alias("category"))


@query("anonymize")
def q_anonymize(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", TX.anonymize_id("c_name").alias("anon_default"),
                    TX.anonymize_id("c_name", "s3cret").alias("anon_salted"))


@query("short_hash")
def q_short_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.short_hash("text").alias("short_hash"), TX.short_hash("text", 64).alias("full_hash"))


@query("path_safe_names")
def q_path_safe_names(spark, sf_dir):
    """T10-T12 over names built from the data (pages URLs stand in for model names)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", TX.path_safe("url").alias("path_safe"), TX.short_model_name("url").alias("short_name"),
                    TX.status_column_name(F.concat(F.lit("Flagged for "), F.col("url"))).alias("status_column"))


# --------------------------------------------------------------------------- cleaning

def _clean_kwargs():
    return dict(anonymize=True, min_length=40, stopwords=FRENCH_STOPWORDS, source_file="documents+pages")


@query("clean_records")
def q_clean_records(spark, sf_dir):
    return CL.clean_records(rsp.document_answers(spark, sf_dir), dedupe=True, **_clean_kwargs())


@query("clean_records_all")
def q_clean_records_all(spark, sf_dir):
    """Same cleaning without dedupe: every kept and audio row."""
    return CL.clean_records(rsp.document_answers(spark, sf_dir), dedupe=False, **_clean_kwargs())


@query("clean_counters")
def q_clean_counters(spark, sf_dir):
    return CL.clean_counters(rsp.document_answers(spark, sf_dir), dedupe=True, **_clean_kwargs())


@query("dedupe_exact")
def q_dedupe_exact(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(TX.short_hash("text", 64).alias("text_hash"), "doc_id", "source")
    return CL.dedupe_first(d, "text_hash", order="doc_id")


@query("resolve_columns")
def q_resolve_columns(spark, sf_dir):
    """Classify an answer sheet whose columns carry other names (resolved from the
    candidate lists: 'answer' -> response, 'prompt' -> question, 'examType' -> type)."""
    a = rsp.document_answers(spark, sf_dir).select(
        "row", F.col("textResponse").alias("answer"), F.col("questionText").alias("prompt"),
        F.col("questionType").alias("examType"), F.col("nim").alias("participant"), "audioResponseUrl",
    )
    c = CL.classify(a, anonymize=True, stopwords=FRENCH_STOPWORDS)
    return c.select("row", "status", "question", "type", "category", "respondent_id", "dedupe_key")


# --------------------------------------------------------------------------- sampling

def _doc_questions(answers):
    return SA.detect_essay_questions(answers.where(F.col("questionType") != "audio"))


@query("detect_questions_by_type")
def q_detect_questions_by_type(spark, sf_dir):
    return SA.detect_questions_by_type(rsp.order_answers(spark, sf_dir), pattern="urgent")


@query("top_questions")
def q_top_questions(spark, sf_dir):
    return SA.top_questions(rsp.document_answers(spark, sf_dir))


@query("sample_per_question")
def q_sample_per_question(spark, sf_dir):
    a = rsp.document_answers(spark, sf_dir)
    return SA.sample_per_question(a, _doc_questions(a), n=SAMPLE_N)


@query("sampling_summary")
def q_sampling_summary(spark, sf_dir):
    a = rsp.document_answers(spark, sf_dir)
    return SA.sampling_summary(a, _doc_questions(a), n=SAMPLE_N)


@query("select_samples")
def q_select_samples(spark, sf_dir):
    a = rsp.document_answers(spark, sf_dir)
    s = SA.sample_per_question(a, _doc_questions(a), n=SAMPLE_N)
    return SA.select_samples(s, max_questions=2, per_question=5).select("sample_file", "question_id", "row", "sample_rank")


# --------------------------------------------------------------------------- scoring plan


# Rater (model) names to plan requests for; the slash exercises the path-safe folder names.
PLAN_MODELS = ["org-a/rater-large", "org-b/rater-small"]
PLAN_RUNS = 3


def _plan(spark, sf_dir, runs=PLAN_RUNS, models=PLAN_MODELS):
    return SC.score_plan(rsp.conversation_samples(spark, sf_dir), models, runs)


def _dry_run_records(spark, sf_dir):
    return SC.response_records(SC.score(_plan(spark, sf_dir), dry_run=True))


@query("prompt_text")
def q_prompt_text(spark, sf_dir):
    s = rsp.conversation_samples(spark, sf_dir)
    return s.select("row", "question_id", "respondent_id", SC.build_prompt(s).alias("prompt"))


@query("score_plan")
def q_score_plan(spark, sf_dir):
    p = _plan(spark, sf_dir)
    return p.select("model", "run", "sample_row", "question_id", "respondent_id", "stem", "model_safe",
                    F.sha2(F.col("prompt"), 256).alias("prompt_sha256"))


@query("severity_ttest_all")
def q_severity_ttest_all(spark, sf_dir):
    """M2 for every pair of models, in one pass over the essays."""
    t = bias.severity_ttest_all(testdata_analysis(spark, sf_dir).scores)
    return rounded(t.select("model_1", "model_2", "tstat", "n_pairs", "degenerate"))


@query("bland_altman_all")
def q_bland_altman_all(spark, sf_dir):
    """M3 for every pair of models, in one pass over the essays."""
    return rounded(bias.bland_altman_all(testdata_analysis(spark, sf_dir).scores))


@query("resume_antijoin")
def q_resume_antijoin(spark, sf_dir):
    """Resume after an interrupted job: model 2 finished its 3 runs, model 1 only 2."""
    done_two_runs = SC.response_records(SC.score(_plan(spark, sf_dir, runs=2), dry_run=True))
    done_model_2 = SC.response_records(SC.score(_plan(spark, sf_dir, models=PLAN_MODELS[1:]), dry_run=True))
    done = done_two_runs.unionByName(done_model_2)
    return _pending(spark, sf_dir, done)


def _pending(spark, sf_dir, done):
    todo = SC.pending_plan(rsp.conversation_samples(spark, sf_dir), PLAN_MODELS, PLAN_RUNS, done)
    return todo.select("model", "run", "sample_row", "question_id", "respondent_id")


@query("resume_from_checkpoint")
def q_resume_from_checkpoint(spark, sf_dir):
    """J6 from files: the checkpoint lies in folders by question and model, those of the job's own
    requests are read; the responses of another model beside them are not."""
    path = scratch_path(spark, "resume-ckpt")
    plan = _plan(spark, sf_dir, models=[*PLAN_MODELS, "org-c/other"])
    half = plan.where((F.col("model") != PLAN_MODELS[0]) | (F.col("run") < PLAN_RUNS))
    SK.write_checkpoint(SC.response_records(SC.score(half, dry_run=True)), path)
    done = JS.completed_requests(spark, path, rsp.conversation_samples(spark, sf_dir), PLAN_MODELS)
    return _pending(spark, sf_dir, done)


@query("append_twice")
def q_append_twice(spark, sf_dir):
    """Two jobs append their responses, one of them twice, and an attempt that never commits lies
    beside them; each response is read back once."""
    base = scratch_path(spark, "eval-jobs")
    recs = rsp.responses(spark, sf_dir).withColumn("response", F.lit(None).cast("string")).select(*SC.RESPONSE_COLUMNS)
    for job, part in (("job-1", F.col("run") <= 2), ("job-1", F.col("run") <= 2), ("job-2", F.col("run") > 2)):
        SK.append_responses(recs.where(part), base, job)
    lost = recs.where("run = 1").withColumns({"job": F.lit("job-3"), "attempt": F.lit("killed")})
    SK.write_responses(lost, base, extra_partitions=["job", "attempt"])
    return JS.read_responses(spark, base).select("model", "run", "sample_row", "question_id", "respondent_id", "raw")


@query("incremental_cells")
def q_incremental_cells(spark, sf_dir):
    """Cells of response files kept between runs; the second run reads only what the second append
    added, and the routing scores are those of all files."""
    from raterkit.operators import cells
    from raterkit.sources import cell_store
    base, store = scratch_path(spark, "eval-incremental"), scratch_path(spark, "cells")
    recs = rsp.responses(spark, sf_dir).withColumn("response", F.lit(None).cast("string")).select(*SC.RESPONSE_COLUMNS)
    for part in (F.col("run") % 2 == 0, F.col("run") % 2 == 1):
        SK.write_responses(recs.where(part), base)
        stored = cell_store.stored_cells(spark, store, base)
    essays = metrics.apply_hitl(cells.scores_of_cells(stored.cells))
    return rounded(essays.select("model", "essay_id", "question_id", "mean_total", "sd_total", "range_total", "n_runs", "hitl_status"))


@query("raw_json_strict")
def q_raw_json_strict(spark, sf_dir):
    """Raw texts that hold a second object, or text after the first, give no scores."""
    r = rsp.raw_responses(spark, sf_dir)
    tail = (F.when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit(" "), F.col("raw"))).when(F.col("l_orderkey") % 5 == 1, F.concat(F.lit(","), F.col("raw")))
            .when(F.col("l_orderkey") % 5 == 2, F.lit("}")).when(F.col("l_orderkey") % 5 == 3, F.lit(" \t")).otherwise(F.lit("")))
    raw = r.withColumns({"raw": F.concat("raw", tail), "parsed": F.lit(None).cast(P.SCORES_TYPE)})
    return rounded(P.with_scores(raw).select("l_orderkey", "l_linenumber", "model", *P.SCORE_FIELDS, "total_score"))


@query("dry_run_scores")
def q_dry_run_scores(spark, sf_dir):
    r = P.with_scores(_dry_run_records(spark, sf_dir))
    return rounded(r.select("model", "run", "sample_row", "question_id", "respondent_id",
                            *P.SCORE_FIELDS, "total_score"))


@query("response_records")
def q_response_records(spark, sf_dir):
    r = _dry_run_records(spark, sf_dir)
    return r.select("model", "run", "sample_row", "question_id", "respondent_id", "response", "raw",
                    *[F.col("parsed").getField(k).alias(f"parsed_{k}") for k in P.SCORE_FIELDS])


def _dry_run_analysis(spark, sf_dir):
    return Analysis(align_inputs(_dry_run_records(spark, sf_dir), None, source="question_id"))


@query("dry_run_summary")
def q_dry_run_summary(spark, sf_dir):
    return rounded(_dry_run_analysis(spark, sf_dir).materialize().summary)


@query("dry_run_ttest")
def q_dry_run_ttest(spark, sf_dir):
    t = _dry_run_analysis(spark, sf_dir).ttest
    return rounded(t.select("model_1", "model_2", "tstat", "pvalue", "n_pairs", "degenerate"))


# --------------------------------------------------------------------------- report tables

def _summary(spark, sf_dir):
    return testdata_analysis(spark, sf_dir).materialize().summary


@query("boxplot_summary")
def q_boxplot_summary(spark, sf_dir):
    return rounded(RP.boxplot_summary(testdata_analysis(spark, sf_dir).scores))


@query("leaderboard")
def q_leaderboard(spark, sf_dir):
    return rounded(RP.leaderboard(_summary(spark, sf_dir)))


@query("relative_to_best")
def q_relative_to_best(spark, sf_dir):
    return rounded(RP.relative_to_best(_summary(spark, sf_dir)))


@query("badges")
def q_badges(spark, sf_dir):
    return RP.badges(_summary(spark, sf_dir))


@query("exec_summary")
def q_exec_summary(spark, sf_dir):
    return rounded(RP.exec_summary(_summary(spark, sf_dir)))


# --------------------------------------------------------------------------- extras from the survey's decisions


@query("scan_rows")
def q_scan_rows(spark, sf_dir):
    """1-based ordinal in scan order (documents are stored in doc_id order)."""
    d = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id")
    return with_row_ordinal(d)


@query("essay_metrics_dedupe_runs")
def q_essay_metrics_dedupe_runs(spark, sf_dir):
    return rounded(testdata_analysis(spark, sf_dir).essay_table(dedupe_runs=True))


@query("model_summary_scored")
def q_model_summary_scored(spark, sf_dir):
    return rounded(metrics.scored_only_summary(testdata_analysis(spark, sf_dir).routed_scores))


# --------------------------------------------------------------------------- sources and sinks
# Round trips through a fresh folder under spark.checkpoint.dir, on data derived from the tables.


@query("tolerant_jsonl")
def q_tolerant_jsonl(spark, sf_dir):
    """Every raw rater text written as text lines (fenced answers span several lines);
    the tolerant scan keeps the lines that are JSON objects and drops the rest."""
    path = scratch_path(spark, "raw-lines")
    rsp.raw_responses(spark, sf_dir).select("raw").write.text(path)
    got = JS.read_jsonl(spark, path, JS.SCORES)
    return got.select(*P.SCORE_FIELDS)


@query("partitioned_append")
def q_partitioned_append(spark, sf_dir):
    """S7 + S3: responses appended per (stem, model, question) folder, a checkpoint folder
    beside them; reading the output folder resolves to the responses only."""
    base = scratch_path(spark, "eval")
    recs = rsp.responses(spark, sf_dir).withColumn("response", F.lit(None).cast("string"))
    recs = recs.select(*SC.RESPONSE_COLUMNS)
    SK.write_responses(recs, base)
    SK.write_checkpoint(_dry_run_records(spark, sf_dir), f"{base}/ckpt")
    back = JS.read_responses(spark, base, checkpoint=f"{base}/ckpt")
    return back.select("model", "run", "sample_row", "question_id", "respondent_id", "raw",
                       *[F.col("parsed").getField(k).alias(f"parsed_{k}") for k in P.SCORE_FIELDS])


@query("input_resolution")
def q_input_resolution(spark, sf_dir):
    """S3 fallback: a folder holding only the checkpoint resolves to the checkpoint."""
    base = scratch_path(spark, "eval-ckpt-only")
    SK.write_checkpoint(_dry_run_records(spark, sf_dir), f"{base}/ckpt")
    back = JS.read_responses(spark, base, checkpoint=f"{base}/ckpt")
    return back.select("model", "run", "sample_row", "question_id", "respondent_id", "raw")


@query("sample_map")
def q_sample_map(spark, sf_dir):
    """Sample records written per question, read back into the question -> prompt map."""
    path = scratch_path(spark, "samples")
    SK.write_samples(rsp.part_samples(spark, sf_dir), path)
    return JS.load_sample_mapping(spark, path)


# --------------------------------------------------------------------------- routing policy options (trap 1)

@query("hitl_distribution_unscored_flag")
def q_hitl_distribution_unscored_flag(spark, sf_dir):
    """Routing where an essay without any scored run is flagged instead of approved."""
    a = testdata_analysis(spark, sf_dir, unscored="flag")
    return rounded(a.distribution)


@query("hitl_distribution_unscored_exclude")
def q_hitl_distribution_unscored_exclude(spark, sf_dir):
    """Routing over scored essays only."""
    a = testdata_analysis(spark, sf_dir, unscored="exclude")
    return rounded(a.distribution)


# --------------------------------------------------------------------------- a chosen model pair (trap 16)

@query("severity_ttest_pair_1_3")
def q_severity_ttest_pair_1_3(spark, sf_dir):
    """The paired test for the first and third model by name (any pair can be chosen)."""
    a = testdata_analysis(spark, sf_dir)
    t = bias.severity_ttest(a.scores, names=a.pair_names(1, 3))
    return rounded(t.select("model_1", "model_2", "tstat", "n_pairs", "degenerate"))


# --------------------------------------------------------------------------- category columns of response files

def _file_responses(spark, sf_dir, columns):
    """Responses with prompt columns of their own, written as files under a folder with a space
    beside a checkpoint, read back and aligned."""
    base = scratch_path(spark, "eval with space")
    own = {
        "category": F.concat(F.lit("cat"), (F.col("sample_row") % 5).cast("string")),
        "topic": F.concat(F.lit("topic"), (F.col("sample_row") % 4).cast("string")),
        "question": F.concat(F.lit("Question "), F.col("question_id")),
        "prompt": F.concat(F.lit("Prompt "), F.col("question_id")),
    }
    recs = rsp.responses(spark, sf_dir).withColumn("response", F.lit(None).cast("string"))
    recs = recs.select(*SC.RESPONSE_COLUMNS, *[own[c].alias(c) for c in columns])
    # every record is on the disk twice; as text, that is thirty times the room of the table
    SK.write_jsonl(recs, f"{base}/run 1", compression="gzip")
    SK.write_checkpoint(recs.select(*SC.RESPONSE_COLUMNS), f"{base}/check point", compression="gzip")
    return JS.read_responses(spark, base, checkpoint=f"{base}/check point")


def _file_aligned(spark, sf_dir, columns, prompt_map=None):
    # parsed and scored once; the probes for the prompt columns and the result read the written records, without texts
    scored = typed_responses(_file_responses(spark, sf_dir, columns))
    responses = cut_lineage(scored.drop("response", "raw", "parsed", *P.SCORE_FIELDS, "_source_file"), "responses")
    a = align_inputs(responses, prompt_map)
    return rounded(a.select("model", "run", "essay_id", "prompt_category", "prompt_question", "prompt_category_source", "total_score"))


@query("file_category")
def q_file_category(spark, sf_dir):
    """P10/P11 from files: the responses' category and question."""
    return _file_aligned(spark, sf_dir, ["category", "topic", "question", "prompt"])


@query("file_topic")
def q_file_topic(spark, sf_dir):
    """P10/P11 from files: without a category the topic, without a question the prompt; a map that
    matches no response does not count."""
    other = rsp.part_samples(spark, sf_dir).withColumn("question_id", F.concat(F.lit("other"), F.col("question_id")))
    from raterkit.operators.align import sample_map
    return _file_aligned(spark, sf_dir, ["topic", "prompt"], sample_map(other)).drop("prompt_question")


@query("file_question_id")
def q_file_question_id(spark, sf_dir):
    """P10/P11 from files: no column names the prompt, so the question id does."""
    return _file_aligned(spark, sf_dir, [])


@query("essay_grain")
def q_essay_grain(spark, sf_dir):
    """A1 where prompt and respondent differ or are missing within an essay: one row per key,
    each attribute its first value by run."""
    a = testdata_analysis(spark, sf_dir).aligned.withColumns({
        "prompt_category": F.when(F.col("run") % 2 == 0, F.concat(F.lit("P"), (F.col("run") % 3).cast("string"))),
        "respondent_id": F.when(F.col("run") > 2, F.col("respondent_id")),
    })
    e = metrics.essay_metrics(a)
    return rounded(e.select("model", "essay_id", "respondent_id", "prompt_category", "mean_total", "range_total", "n_runs"))


# --------------------------------------------------------------------------- sinks and reuse

@query("jsonl_sink")
def q_jsonl_sink(spark, sf_dir):
    """Scoring samples as JSON lines, read back."""
    path = scratch_path(spark, "jsonl")
    SK.write_jsonl(rsp.conversation_samples(spark, sf_dir), path)
    back = JS.read_jsonl(spark, path, JS.SAMPLE_SCHEMA)
    return back.select(F.col("row").try_cast("long").alias("row"), "question_id", "respondent_id", "question", "response")


@query("json_document")
def q_json_document(spark, sf_dir):
    """The cleaning counters as one indented JSON document, read back."""
    path = scratch_path(spark, "document")
    counters = CL.clean_counters(rsp.document_answers(spark, sf_dir), dedupe=True, **_clean_kwargs())
    SK.write_json_document(counters, path)
    return spark.read.schema(counters.schema).option("multiLine", "true").json(path)


@query("overwrite_layout")
def q_overwrite_layout(spark, sf_dir):
    """A sample file's responses overwrite their own folders; ``_samples`` leaves the stem, and
    the folder of a response without a question id is named by the question's text, else the stem."""
    path = scratch_path(spark, "eval-overwrite")
    named = _dry_run_records(spark, sf_dir).withColumns({
        "stem": F.concat(F.lit("question_"), F.col("question_id"), F.lit("_samples")),
        "question_text": F.when(F.col("question_id") == "1", F.lit("What is it?")),
        "question_id": F.when(F.col("question_id") == "0", F.col("question_id")).otherwise(F.lit("")),
    })
    SK.write_responses(named, path, mode="overwrite")
    SK.write_responses(named.where(F.col("model") == PLAN_MODELS[0]), path, mode="overwrite")
    back = spark.read.schema("run int, stem string, model_dir string, question string").json(path)
    return back.groupBy("stem", "model_dir", "question").agg(F.count(F.lit(1)).alias("responses"))


@query("csv_sink")
def q_csv_sink(spark, sf_dir):
    """Topic means as CSV with a header line, read back."""
    path = scratch_path(spark, "csv")
    topics = rounded(testdata_analysis(spark, sf_dir).topics)
    SK.write_csv(topics, path)
    return spark.read.schema(topics.schema).option("header", "true").csv(path)


@query("result_reuse")
def q_result_reuse(spark, sf_dir):
    """The routing distribution, stored and reused for the same inputs and thresholds."""
    path = scratch_path(spark, "reuse")
    manifest = {"files": SK.input_state(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet"), "cv_threshold": metrics.CV_THRESHOLD}
    SK.reuse_or_compute(spark, path, lambda: testdata_analysis(spark, sf_dir).distribution, manifest)

    def again():
        raise AssertionError("a stored result was not reused")

    return rounded(SK.reuse_or_compute(spark, path, again, manifest))


@query("report_json")
def q_report_json(spark, sf_dir):
    """The report written as a JSON document and read back, its summary part as rows."""
    path = scratch_path(spark, "report")
    a = testdata_analysis(spark, sf_dir).materialize()
    SK.write_report_json(SK.report_lines(a.summary, a.ttest, a.topics, a.distribution, a.category_source), path)
    schema = ("prompt_category_source string, metrics_summary array<struct<model:string,n_essays:bigint,mean_total:double,icc_total:double>>, "
              "severity_bias_ttest struct<n_pairs:bigint>")
    back = spark.read.schema(schema).option("multiLine", "true").json(path)
    rows = back.select("prompt_category_source", "severity_bias_ttest.n_pairs", F.explode("metrics_summary").alias("m"))
    return rounded(rows.select("prompt_category_source", "n_pairs", "m.model", "m.n_essays", "m.mean_total", "m.icc_total"))


# --------------------------------------------------------------------------- scoring with a scorer (B2), raw JSON (R3), names

def _length_scorer(prompts, models):
    """A deterministic batch scorer: scores from the lengths of prompt and model name."""
    return [
        f'{{"grammar": {len(p) % 8}, "lexical": {len(p) % 7}, "coherence": {len(m) % 6}, "task": {(len(p) + len(m)) % 10}}}'
        for p, m in zip(prompts, models)
    ]


@query("batch_scorer")
def q_batch_scorer(spark, sf_dir):
    """B2: every request scored by a batch scorer in Arrow batches, then parsed."""
    scored = SC.response_records(SC.score(_plan(spark, sf_dir), batch_scorer=_length_scorer))
    return rounded(P.with_scores(scored).select("model", "run", "sample_row", "respondent_id", *P.SCORE_FIELDS, "total_score"))


@query("raw_json_scores")
def q_raw_json_scores(spark, sf_dir):
    """Records that store no parsed scores; raw texts that are one JSON object supply them."""
    raw = rsp.raw_responses(spark, sf_dir).withColumn("parsed", F.lit(None).cast(P.SCORES_TYPE))
    return rounded(P.with_scores(raw).select("l_orderkey", "l_linenumber", "model", *P.SCORE_FIELDS, "total_score"))


@query("select_samples_by_name")
def q_select_samples_by_name(spark, sf_dir):
    """Sample files chosen by name."""
    a = rsp.document_answers(spark, sf_dir)
    s = SA.sample_per_question(a, _doc_questions(a), n=SAMPLE_N)
    names = ["question_src0_samples.jsonl", "question_src1_samples.jsonl", "question_src10_samples.jsonl"]
    return SA.select_samples(s, names=names, per_question=3).select("sample_file", "question_id", "row", "sample_rank")
