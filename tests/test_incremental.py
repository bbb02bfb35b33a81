"""Mergeable cells, incremental reuse, resumed checkpoints, appends that run once, sheets read in splits."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from raterkit.functions import parse as P
from raterkit.operators import cells, icc, metrics
from raterkit.operators import scoring as SC
from raterkit.operators.align import align_inputs
from raterkit.plans import responses as rsp
from raterkit.plans.stages import run_analysis
from raterkit.session import cut_bucketed
from raterkit.sources import cell_store
from raterkit.sources import jsonl as J
from raterkit.sources import sinks as K
from raterkit.sources.answers import read_answers
from raterkit.sources.quoted_csv import csv_records


def _tmp():
    return tempfile.mkdtemp(prefix="raterkit-incr-")


def _records(spark):
    return rsp.responses(spark, SF_SMALL).withColumn("response", F.lit(None).cast("string")).select(*SC.RESPONSE_COLUMNS)


def _rows(df, *columns):
    names = columns or df.columns
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in names)) for r in df.collect()), key=str)


# --- cells


def test_cells_give_the_same_essays_and_icc(spark):
    aligned = align_inputs(_records(spark), None, source="samples.category", defer_prompts=True)
    aligned = aligned.unionByName(aligned.where("run = 2"))  # repeated runs
    table = cut_bucketed(cells.cells_of(aligned), cells.KEYS, "cells")
    direct = metrics.essay_metrics(aligned)
    assert _rows(cells.scores_of_cells(table), *direct.columns) == _rows(direct)
    assert _rows(icc.icc_of_runs(cells.runs_of_cells(table))) == _rows(icc.icc_by_model(aligned))
    # states of the same cells from two inputs merge
    parts = cells.cells_of(aligned.where("sample_row % 2 = 0 or run = 1")).unionByName(cells.cells_of(aligned.where("not (sample_row % 2 = 0 or run = 1)")))
    assert _rows(cells.scores_of_cells(parts), *direct.columns) == _rows(direct)


def test_buckets_spare_the_exchange(spark):
    table = cut_bucketed(cells.cells_of(align_inputs(_records(spark), None, source="samples.category", defer_prompts=True)), cells.KEYS, "cells")
    plan = cells.scores_of_cells(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortAggregate" not in plan


def test_cells_merge_equal_scores_without_spread(spark):
    rows = [("m", "e", r, 7.3) for r in (1, 1, 2, 3, 3, 3)]
    df = spark.createDataFrame(rows, "model string, essay_id string, run int, total_score double")
    out = cells.scores_of_cells(cells.cells_of(df)).first()
    assert out.n_runs == 6 and out.mean_total == pytest.approx(7.3) and out.sd_total < 1e-12 and out.range_total == 0.0


def test_ids_from_keys_that_split_in_several_ways(spark):
    rows = [("m", "a|b", "c", "1", 2), ("m", "a", "b|c", "1", 1), ("m", "a", "b|c", "1", 3), ("m", None, "", "5", 1), ("m", "", "", "5", 2), ("m", None, None, None, 1)]
    df = spark.createDataFrame(rows, "model string, respondent_id string, question_id string, sample_row string, run int")
    df = df.withColumns({"total_score": F.lit(1.0), "raw": F.lit(None).cast("string")})
    for essays in (metrics.essay_metrics, lambda a: cells.scores_of_cells(cells.cells_of(a))):
        out = {r.essay_id: (r.respondent_id, r.question_id, r.sample_row) for r in essays(align_inputs(df, None, source="samples.category", defer_prompts=True)).collect()}
        assert out == {"a|b|c|1": ("a", "b|c", "1"), "||5": ("", "", "5"), "||": (None, None, None)}


# --- incremental reuse


def test_a_new_file_is_read_alone(spark, monkeypatch):
    out, read = _tmp(), []
    inner = cell_store.read_response_files
    monkeypatch.setattr(cell_store, "read_response_files", lambda s, paths: read.append(sorted(paths)) or inner(s, paths))
    samples, recs = f"{out}/prep", _records(spark)
    K.write_samples(rsp.part_samples(spark, SF_SMALL), samples)
    recs.where("run <= 3").coalesce(1).write.json(f"{out}/eval/a [1]")
    first = run_analysis(spark, f"{out}/eval", f"{out}/analysis", samples_dir=samples)
    assert first["files_read"] == 1 and not first["reused"]
    recs.where("run > 3").coalesce(1).write.json(f"{out}/eval/b")
    second = run_analysis(spark, f"{out}/eval", f"{out}/analysis", samples_dir=samples)
    assert second["files_read"] == 1 and len(read) == 2 and len(read[1]) == 1 and "/b/" in read[1][0]
    whole = run_analysis(spark, f"{out}/eval", f"{out}/fresh", samples_dir=samples)
    assert whole["files_read"] == 2
    for name in ("essays", "summary", "ttest", "distribution"):
        assert _rows(second[name]) == _rows(whole[name]), name
    again = run_analysis(spark, f"{out}/eval", f"{out}/analysis", samples_dir=samples)
    assert again["reused"] and again["files_read"] == 0
    # other thresholds: nothing is read
    other = run_analysis(spark, f"{out}/eval", f"{out}/analysis", samples_dir=samples, cv_threshold=0.1)
    assert not other["reused"] and other["files_read"] == 0 and len(read) == 3


def test_changed_files_and_lost_generations(spark):
    out, recs = _tmp(), _records(spark)
    recs.where("run <= 3").coalesce(1).write.json(f"{out}/eval/a")
    store = f"{out}/cells"
    n = cell_store.stored_cells(spark, store, f"{out}/eval").cells.count()
    # a generation without its line in the log (a run that died) does not count
    cells.cells_of(align_inputs(recs, None, source="samples.category", defer_prompts=True)).write.parquet(f"{store}/cells/lost")
    assert cell_store.stored_cells(spark, store, f"{out}/eval").cells.count() == n
    recs.where("run <= 2").coalesce(1).write.mode("overwrite").json(f"{out}/eval/a")  # rewritten
    changed = cell_store.stored_cells(spark, store, f"{out}/eval")
    assert changed.files_read == 1 and changed.cells.select("run").distinct().count() == 2
    assert cell_store.stored_cells(spark, store, f"{out}/eval", force=True).files_read == 1
    os.makedirs(f"{out}/none")
    assert cell_store.stored_cells(spark, f"{out}/other", f"{out}/none") is None


# --- resume


def _plan(spark, models, runs=3):
    return SC.score_plan(rsp.conversation_samples(spark, SF_SMALL), models, runs)


def test_resume_reads_the_folders_of_its_requests(spark):
    d = os.path.join(_tmp(), "ckpt")
    K.write_checkpoint(SC.response_records(SC.score(_plan(spark, ["org/a", "org/b", "c"], 2), dry_run=True)), d)
    samples = rsp.conversation_samples(spark, SF_SMALL).where("question_id = '1'")
    done = J.completed_requests(spark, d, samples, ["org/a"])
    assert {r.model for r in done.collect()} == {"org/a"}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "question_dir" in plan.split("PartitionFilters")[1].split("]")[0] + plan.split("PartitionFilters")[1]
    todo = SC.pending_plan(samples, ["org/a", "org/b"], 3, J.completed_requests(spark, d, samples, ["org/a", "org/b"]))
    assert {(r.model, r.run) for r in todo.select("model", "run").collect()} == {("org/a", 3), ("org/b", 3)}
    assert todo.count() == 2 * samples.count()
    assert J.completed_requests(spark, d + "-none", samples, ["org/a"]) is None


def test_other_folders_are_not_opened(spark):
    d = os.path.join(_tmp(), "ckpt")
    K.write_checkpoint(SC.response_records(SC.score(_plan(spark, ["a", "b"], 1), dry_run=True)), d)
    for q in os.listdir(d):
        if q.startswith("question_dir") and q != "question_dir=2":
            for base, _, files in os.walk(os.path.join(d, q)):
                for f in files:
                    os.remove(os.path.join(base, f))
                    if f.endswith(".json"):
                        os.mkdir(os.path.join(base, f))  # opening it as a file fails
    samples = rsp.conversation_samples(spark, SF_SMALL).where("question_id = '2'")
    assert J.completed_requests(spark, d, samples, ["a"]).count() == samples.count()


@pytest.mark.parametrize("small", [0, 3, 100_000])
def test_pending_plan_by_size(spark, small):
    samples = rsp.conversation_samples(spark, SF_SMALL)
    done = SC.response_records(SC.score(_plan(spark, ["a", "b"], 2).where("sample_row < 4 or model = 'b'"), dry_run=True))
    want = SC.pending_requests(SC.score_plan(samples, ["a", "b"], 3), done)
    got = SC.pending_plan(samples, ["a", "b"], 3, done, small=small)
    assert got.columns == want.columns and _rows(got) == _rows(want)
    if small == 100_000:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not any("response" in line for line in plan.split("\n") if "Exchange hashpartitioning(_" in line)


# --- appends


def test_append_runs_once(spark):
    out, recs = _tmp(), _records(spark)
    assert K.append_responses(recs.where("run = 1"), out, "job-a") is True
    assert K.append_responses(recs.where("run = 1"), out, "job-a") is False
    K.write_responses(recs.where("run = 2").withColumns({"job": F.lit("job-b"), "attempt": F.lit("killed")}), out, extra_partitions=["job", "attempt"])
    assert {r.run for r in J.read_responses(spark, out).select("run").distinct().collect()} == {"1"}
    assert K.append_responses(recs.where("run = 2"), out, "job-b") is True  # the job again
    back = J.read_responses(spark, out)
    assert back.count() == recs.where("run <= 2").count() == back.dropDuplicates(["model", "run", "sample_row", "respondent_id", "raw"]).count() + (
        recs.where("run <= 2").count() - recs.where("run <= 2").dropDuplicates(["model", "run", "sample_row", "respondent_id", "raw"]).count())
    assert J.response_files(spark, out).where("path like '%attempt=killed%'").isEmpty()
    # two attempts of one job that both committed: the first counts
    again = recs.where("run = 3").withColumns({"job": F.lit("job-c"), "attempt": F.col("model")})
    K.write_responses(again, out, extra_partitions=["job", "attempt"])
    for model in ("N", "A"):
        line = spark.createDataFrame([("job-c", model)], "job string, attempt string").withColumn("written", F.current_timestamp())
        line.coalesce(1).write.mode("append").json(f"{out}/{K.COMMITS}")
    assert {r.model for r in J.read_responses(spark, out).where("run = '3'").select("model").distinct().collect()} == {"N"}
    with pytest.raises(ValueError):
        K.append_responses(recs, out, "a/b")


# --- one JSON object


def test_is_json_object(spark):
    good = ['{"a":1}', ' {"a":{"b":[1,2]}} \n', "{}", '{"a":"}{"}', '{"a":"\\"} {"}', '{"a":[{"b":1},{"c":2}]}']
    bad = ['{"a":1} {"a":2}', '{"a":1},{"a":2}', '{"a":1}}', '{"a":1}]', '{"a":1}],"w":[{"b":2}', '{"a":1},"b":{"c":1}', '{"a":1}} {"b":2}', "[1]", "", "{'a':1}",
           '{"a":1}],[{"b":2}', '{"a":1} x {}', None, '{"a":1', '{"a":1},{}', '{"a":1},"v":[{"b":2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string")
    out = [r.ok for r in df.select("i", P.is_json_object("t").alias("ok")).orderBy("i").collect()]
    assert out == [True] * len(good) + [False] * len(bad)
    raws = [(x, None) for x in ('{"grammar":7,"lexical":6,"coherence":5,"task":4}', '{"grammar":7,"lexical":6,"coherence":5,"task":4} {"grammar":1}')]
    scored = P.with_scores(spark.createDataFrame(raws, f"raw string, parsed {P.SCORES_TYPE}")).select("total_score").collect()
    assert [r.total_score for r in scored] == [22.0, None]


# --- sheets


SHEET = 'id,textResponse,"question, text"\r\n1,"a ""quoted"" word",q1\r\n2,"line one\r\nline two\n\nline four",q2\r\n\r\n3,plain,"x,y"\r\n4,,\r\n5,"ends with break\n",q5'


def test_quoted_sheet_in_splits(spark):
    d = _tmp()
    path = os.path.join(d, "sheet.csv")
    body = SHEET + "".join(f'\r\n{i},"row {i}\n""{"x" * (i % 60)}""\r\n,",q{i % 7}' for i in range(6, 900))
    open(path, "w", newline="", encoding="utf-8").write(body)
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        whole = read_answers(spark, path, multi_line="file")
        split = read_answers(spark, path)
        assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 10
        assert split.columns == whole.columns
        assert _rows(split) == _rows(whole)
        assert csv_records(spark, path).count() == 1 + 899
    finally:
        for k in conf:
            spark.conf.unset(k)
    typed = read_answers(spark, path, schema="id int, textResponse string, q string")
    assert typed.where("id = 2").first().textResponse == "line one\nline two\n\nline four" and typed.where("id = 899").first().row == 899


def test_quoted_sheet_edges(spark):
    d = _tmp()
    for name, body, n in (("empty", "", 0), ("header", "a,b\n", 0), ("one", 'a,b\n"x\ny",2', 1)):
        path = os.path.join(d, f"{name}.csv")
        open(path, "w", newline="").write(body)
        assert read_answers(spark, path).count() == n
    os.makedirs(os.path.join(d, "two"))
    for k in (1, 2):
        open(os.path.join(d, "two", f"{k}.csv"), "w").write(f'a,b\n"{k}\n",x\n{k}{k},y\n')
    out = read_answers(spark, os.path.join(d, "two"))
    assert sorted((r.row, r.a) for r in out.collect()) == [(1, "1\n"), (2, "11"), (3, "2\n"), (4, "22")]


def test_counters_are_a_document(spark):
    from raterkit.plans.stages import run_clean

    out = _tmp()
    run_clean(rsp.document_answers(spark, SF_SMALL), f"{out}/clean", dedupe=True)
    text = "".join(open(os.path.join(out, "clean/metadata", f), encoding="utf-8").read() for f in os.listdir(f"{out}/clean/metadata") if f.startswith("part-"))
    assert set(json.loads(text)) == {"total_rows", "audio_only", "short_or_empty", "filtered_noisy", "deduped", "kept"} and text.count("\n") > 3
