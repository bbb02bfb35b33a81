"""The three stages end to end, writing the same set of outputs as the reference's commands.

* ``run_clean``: answer sheet -> cleaned records (JSON lines) + counters (one JSON document).
* ``run_sample``: answer sheet -> per-question samples (JSON lines per question) + summary.
* ``run_analysis``: response folder (+ samples) -> essay table with routing (CSV + parquet),
  model summary (CSV + parquet), report (JSON). Stored essay and summary tables are reused
  when present for the same inputs and thresholds (S10); only the cheap tables are
  recomputed from them, as the reference does. With new response files, only these are read:
  their cells join those of the files before (``sources.cell_store``).

All outputs are Spark writers; nothing is collected except model-grain report rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from raterkit.operators import bias, cells, clean, icc, metrics, sample
from raterkit.operators.align import align_inputs, category_source, has_category, values_present
from raterkit.plans.analysis import NARROW_COLUMNS
from raterkit.session import cut_bucketed, cut_lineage
from raterkit.sources import cell_store, sinks
from raterkit.sources.jsonl import find_samples, load_sample_mapping, read_responses


def run_clean(answers: DataFrame, out_dir: str, *, dedupe: bool = False, **kwargs) -> DataFrame:
    """Cleaned records to ``<out>/cleaned`` (JSON lines) and counters (a JSON document) to ``<out>/metadata``.

    The answers are classified once, into narrow rows (number, status, key) that dedupe and counters
    read; without dedupe the records are written straight from the classification."""
    narrow = clean.narrow_of(answers, **kwargs)
    records = clean.deduplicated(answers, narrow, **kwargs) if dedupe else clean.clean_records(answers, **kwargs)
    sinks.write_jsonl(records, f"{out_dir}/cleaned")
    sinks.write_json_document(clean.counters_of(narrow, dedupe), f"{out_dir}/metadata")
    return records


def run_sample(answers: DataFrame, out_dir: str, *, per_question: int = sample.PER_QUESTION,
               min_length: int = 40, salt: str | None = None) -> DataFrame:
    """Samples per question to ``<out>/samples`` and the per-question summary to ``<out>/samples_summary``."""
    questions = sample.detect_essay_questions(answers)
    samples = sample.sample_per_question(answers, questions, n=per_question, min_length=min_length, salt=salt)
    sinks.write_samples(samples.drop("sample_rank"), f"{out_dir}/samples")
    summary = sample.sampling_summary(answers, questions, n=per_question, min_length=min_length)
    sinks.write_jsonl(summary, f"{out_dir}/samples_summary")
    return samples


def _from_cells(spark: SparkSession, inputs: str, out_dir: str, checkpoint: str | None, pmap: DataFrame | None, force: bool):
    """Essay table, ICC statistics and category source from the stored cells of the response files;
    only files that are new since the last run are read. Without a result where responses carry
    prompt columns of their own, which cells do not hold, or there are none."""
    stored = None if pmap is None else cell_store.stored_cells(spark, f"{out_dir}/cells", inputs, checkpoint, force)
    if stored is None or stored.present & {"prompt_category", "prompt_question"}:
        return None, None, None, 0
    table = cut_bucketed(stored.cells, cells.KEYS, "cells")
    essays = cells.scores_of_cells(table)
    if not has_category(essays, pmap):
        return None, None, None, 0
    return metrics.attach_prompts(essays, pmap), icc.icc_of_runs(cells.runs_of_cells(table)), "samples.category", stored.files_read


def _from_responses(spark: SparkSession, inputs: str, checkpoint: str | None, pmap: DataFrame | None):
    """The same from all responses."""
    # parsed once: the probes below and the result read the written records
    responses = cut_lineage(read_responses(spark, inputs, checkpoint=checkpoint).drop("response", "_source_file"), "responses")
    source = category_source(responses, pmap).first()[0]
    # a category that only the map has is attached to the essays, not carried per response
    defer = pmap is not None and source == "samples.category" and not values_present(responses, ["prompt_category", "prompt_question"])
    aligned = align_inputs(responses, None if defer else pmap, source=None if not defer else source, defer_prompts=defer)
    aligned = cut_lineage(aligned.select(*[c for c in NARROW_COLUMNS if c in aligned.columns]), "aligned")
    table = metrics.essay_metrics(aligned)
    if defer:
        table = metrics.attach_prompts(table, pmap)
    return table, icc.icc_stats(aligned), source


def run_analysis(spark: SparkSession, inputs: str, out_dir: str, *, samples_dir: str | None = None,
                 find_samples_dir: bool = True, checkpoint: str | None = None,
                 cv_threshold: float = metrics.CV_THRESHOLD,
                 range_threshold: float = metrics.RANGE_THRESHOLD, force: bool = False) -> dict:
    """Analysis of a response folder; returns the result tables by name (and ``reused``).

    Without ``samples_dir`` a folder ``samples`` beside or in the input is used, if there is
    one (unless ``find_samples_dir`` is false).
    """
    if samples_dir is None and find_samples_dir:
        samples_dir = find_samples(spark, inputs)
    # sizes and times of all input files are part of the manifest
    manifest = {"inputs": inputs, "samples": samples_dir, "checkpoint": checkpoint,
                "files": sinks.input_state(spark, inputs, samples_dir, checkpoint),
                "cv_threshold": cv_threshold, "range_threshold": range_threshold}
    essays_at, summary_at = f"{out_dir}/hitl_routing_table", f"{out_dir}/metrics_summary_table"
    old_essays = None if force else sinks.stored_result(spark, essays_at, manifest)
    old_summary = None if force else sinks.stored_result(spark, summary_at, manifest)
    reused = old_essays is not None and old_summary is not None
    files_read = 0
    if reused:
        (essays, source), (summary, _) = old_essays, old_summary
    else:
        pmap = load_sample_mapping(spark, samples_dir) if samples_dir else None
        table, stats, source, files_read = _from_cells(spark, inputs, out_dir, checkpoint, pmap, force)
        if table is None:
            table, stats, source = _from_responses(spark, inputs, checkpoint, pmap)
        essays = sinks.store_result(spark, essays_at, metrics.apply_hitl(table, cv_threshold, range_threshold), manifest, source)
        summary = sinks.store_result(spark, summary_at, metrics.model_summary(essays, stats), manifest, source)
    dist = metrics.hitl_distribution(essays)
    names = bias.model_pair(summary)
    ttest = bias.severity_ttest(essays, names=names)
    topics = bias.topic_means(essays)
    provenance = spark.createDataFrame([(source,)], "prompt_category_source string")

    sinks.write_csv(summary, f"{out_dir}/metrics_summary")
    sinks.write_csv(essays, f"{out_dir}/hitl_routing")
    sinks.write_report_json(sinks.report_lines(summary, ttest, topics, dist, provenance), f"{out_dir}/report")
    return {"reused": reused, "files_read": files_read, "essays": essays, "summary": summary, "distribution": dist, "ttest": ttest, "topics": topics,
            "bland_altman": bias.bland_altman(essays, names=names), "category_questions": bias.category_questions(essays)}
