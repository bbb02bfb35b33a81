"""The three stages end to end on data derived from the test tables: clean, sample, score, analyze."""

import json
import os
import tempfile

from conftest import SF_SMALL
from raterkit.operators import scoring as SC
from raterkit.plans import responses as rsp
from raterkit.plans.stages import run_analysis, run_clean, run_sample
from raterkit.sources import jsonl as J
from raterkit.sources import sinks as K


def _json_rows(folder):
    out = []
    for f in sorted(os.listdir(folder)):
        if f.endswith(".json"):
            out += [json.loads(x) for x in open(os.path.join(folder, f), encoding="utf-8")]
    return out


def _document(folder):
    return json.loads("".join(open(os.path.join(folder, f), encoding="utf-8").read() for f in os.listdir(folder) if f.startswith("part-")))


def test_clean_sample_score_analyze(spark):
    out = tempfile.mkdtemp(prefix="raterkit-stages-")
    answers = rsp.document_answers(spark, SF_SMALL)
    records = run_clean(answers, f"{out}/clean", anonymize=True, dedupe=True, stopwords=["le", "la", "les", "de"])
    counters = _document(f"{out}/clean/metadata")
    assert counters["total_rows"] == answers.count()
    assert counters["kept"] == records.count() == len(_json_rows(f"{out}/clean/cleaned"))
    assert counters["total_rows"] == sum(counters[k] for k in ("short_or_empty", "filtered_noisy", "deduped", "kept"))

    run_sample(answers.where("questionType != 'audio'"), f"{out}/prep", per_question=5)
    summary = _json_rows(f"{out}/prep/samples_summary")
    assert len(summary) == 3 and all(s["sampled"] == min(5, s["total_valid"]) for s in summary)
    samples = J.read_samples(spark, f"{out}/prep/samples")
    assert samples.count() == sum(s["sampled"] for s in summary)

    plan = SC.score_plan(samples.withColumn("row", samples["row"].cast("long")), ["org/m-1", "org/m-2"], 3)
    K.write_responses(SC.response_records(SC.score(plan, dry_run=True)), f"{out}/eval")

    res = run_analysis(spark, f"{out}/eval", f"{out}/analysis", samples_dir=f"{out}/prep/samples")
    assert res["reused"] is False
    rows = {r.model: r for r in res["summary"].collect()}
    assert set(rows) == {"org/m-1", "org/m-2"}
    assert all(r.mean_total == 28.0 and r["auto-approve"] == 100.0 and r.icc_total is None for r in rows.values())
    t = res["ttest"].first()
    assert (t.tstat, t.pvalue, t.degenerate) == (0.0, 1.0, True)
    report = _document(f"{out}/analysis/report")
    assert report["prompt_category_source"] == "samples.category"
    assert spark.read.option("header", True).csv(f"{out}/analysis/hitl_routing").count() == res["essays"].count()

    again = run_analysis(spark, f"{out}/eval", f"{out}/analysis", samples_dir=f"{out}/prep/samples")
    assert again["reused"] is True
    assert again["summary"].count() == 2
    changed = run_analysis(spark, f"{out}/eval", f"{out}/analysis", samples_dir=f"{out}/prep/samples", cv_threshold=0.1)
    assert changed["reused"] is False


def test_reuse_detects_new_input_files(spark):
    out = tempfile.mkdtemp(prefix="raterkit-stages-")
    samples = rsp.conversation_samples(spark, SF_SMALL)
    first = SC.response_records(SC.score(SC.score_plan(samples, ["a", "b"], 2), dry_run=True))
    K.write_responses(first, f"{out}/eval")
    assert run_analysis(spark, f"{out}/eval", f"{out}/analysis")["reused"] is False
    assert run_analysis(spark, f"{out}/eval", f"{out}/analysis")["reused"] is True
    more = SC.response_records(SC.score(SC.score_plan(samples, ["c"], 2), dry_run=True))
    K.write_responses(more, f"{out}/eval")  # appended files
    res = run_analysis(spark, f"{out}/eval", f"{out}/analysis")
    assert res["reused"] is False and res["summary"].count() == 3
