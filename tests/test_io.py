"""Sources and sinks round trips (S1-S11) and the incremental scoring stream, in fresh temp folders."""

import glob
import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from raterkit.operators import scoring as SC
from raterkit.operators.align import align_inputs
from raterkit.plans import responses as rsp
from raterkit.plans.analysis import Analysis
from raterkit.plans.queries import QUERIES
from raterkit.session import ensure_checkpoint_dir
from raterkit.sources import jsonl as J
from raterkit.sources import sinks as K
from raterkit.sources.answers import read_answers, with_row_ordinal
from raterkit.streaming.incremental import start_scoring_stream


def _tmp():
    return tempfile.mkdtemp(prefix="raterkit-test-")


def test_row_ordinal_is_contiguous(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(5)
    rows = with_row_ordinal(df).select("row").collect()
    vals = sorted(r[0] for r in rows)
    assert vals == list(range(1, len(vals) + 1))


def test_read_answers_csv(spark):
    d = _tmp()
    path = os.path.join(d, "sheet.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('textResponse,questionId\n"first, answer",q1\nsecond,q2\n')
    df = read_answers(spark, path)
    got = [(r["row"], r["textResponse"]) for r in df.orderBy("row").collect()]
    assert got == [(1, "first, answer"), (2, "second")]


def test_tolerant_jsonl_and_resolution(spark):
    d = _tmp()
    os.makedirs(os.path.join(d, "eval", "q1", "m"))
    good = {"model": "m/a", "run": 1, "sample_row": 3, "question_id": "q1", "respondent_id": "r",
            "response": "x", "raw": "{}", "parsed": {"grammar": 7, "lexical": 6, "coherence": 5, "task": 4}}
    with open(os.path.join(d, "eval", "q1", "m", "q1.jsonl"), "w") as f:
        f.write(json.dumps(good) + "\n")
        f.write("{not json\n")
        f.write(json.dumps({**good, "run": "2"}) + "\n")
        f.write(json.dumps({"question_id": "q1", "response": "sample without model"}) + "\n")
    with open(os.path.join(d, "eval", "checkpoint.jsonl"), "w") as f:
        f.write(json.dumps({**good, "run": 9}) + "\n")
    df = J.read_responses(spark, os.path.join(d, "eval"))
    assert sorted(r["run"] for r in df.collect()) == ["1", "2"]
    # only the checkpoint present -> it is used
    os.makedirs(os.path.join(d, "only"))
    with open(os.path.join(d, "only", "checkpoint.jsonl"), "w") as f:
        f.write(json.dumps({**good, "run": 5}) + "\n")
    assert [r["run"] for r in J.read_responses(spark, os.path.join(d, "only")).collect()] == ["5"]
    # scores come from the parsed strings; totals from all four
    a = align_inputs(df, None, source="question_id")
    assert sorted(r["total_score"] for r in a.collect()) == [22.0, 22.0]


def test_sample_mapping(spark):
    d = _tmp()
    recs = [
        {"question_id": "q1", "category": "", "prompt_category": "pc", "question": "Q one", "row": 5},
        {"question_id": "q1", "category": "cat", "question": "Q other", "row": 2},
        {"question_id": None, "category": "x", "row": 1},
    ]
    with open(os.path.join(d, "question_q1_samples.jsonl"), "w") as f:
        for r in recs:
            f.write(json.dumps(r) + "\n")
    m = {r["question_id"]: (r["prompt_category"], r["prompt_question"]) for r in J.load_sample_mapping(spark, d).collect()}
    assert m == {"q1": ("cat", "Q other")}


def test_partitioned_append_and_readback(spark):
    d = _tmp()
    samples = rsp.conversation_samples(spark, SF_SMALL)
    plan = SC.score_plan(samples, ["org/model-a", "model-b"], 2)
    recs = SC.response_records(SC.score(plan, dry_run=True))
    K.write_responses(recs, os.path.join(d, "eval"))
    K.write_checkpoint(recs, os.path.join(d, "ckpt"))
    back = J.read_responses(spark, os.path.join(d, "eval"))
    assert back.count() == recs.count()
    assert {r[0] for r in back.select("model").distinct().collect()} == {"org/model-a", "model-b"}
    dirs = os.listdir(os.path.join(d, "eval"))
    assert all(x.startswith("stem=question_") for x in dirs if not x.startswith(("_", ".")))
    # resume: nothing left once everything is in the checkpoint
    done = J.read_responses(spark, os.path.join(d, "ckpt"))
    assert SC.pending_requests(plan, done).count() == 0


def test_resume_key_semantics(spark):
    plan = spark.createDataFrame(
        [("m", 1, 0, None), ("m", 1, None, "r"), ("m", 2, 4, "r"), ("m", 1, 4, None)],
        "model string, run int, sample_row long, respondent_id string")
    done = spark.createDataFrame(
        [("m", "1", None, None), ("m", "1", "0", "r"), ("m", "1", "4", "x")],
        "model string, run string, sample_row string, respondent_id string")
    left = {(r.run, r.sample_row, r.respondent_id) for r in SC.pending_requests(plan, done).collect()}
    # row 0 and NULL both key as -1; NULL respondent matches NULL
    assert left == {(2, 4, "r"), (1, 4, None)}


def test_scorer_errors_become_text(spark):
    plan = SC.score_plan(rsp.conversation_samples(spark, SF_SMALL), ["m"], 1).limit(6)

    def flaky(prompt, model):
        if len(prompt) % 2:
            raise RuntimeError("boom")
        return '{"grammar": 1, "lexical": 2, "coherence": 3, "task": 4}'

    out = SC.response_records(SC.score(plan, flaky)).collect()
    assert out and all(r.raw.startswith("ERROR: boom") or r.parsed is not None for r in out)


def test_reuse_manifest(spark):
    d = _tmp()
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    K.reuse_or_compute(spark, d, compute, {"cv": 0.15})
    K.reuse_or_compute(spark, d, compute, {"cv": 0.15})
    assert len(calls) == 1
    K.reuse_or_compute(spark, d, compute, {"cv": 0.2})
    assert len(calls) == 2
    K.reuse_or_compute(spark, d, compute, {"cv": 0.2}, force=True)
    assert len(calls) == 3


def test_report_json(spark):
    d = _tmp()
    recs = SC.response_records(SC.score(SC.score_plan(rsp.conversation_samples(spark, SF_SMALL), ["a", "b"], 2),
                                        dry_run=True))
    an = Analysis(align_inputs(recs, None, source="question_id"))
    K.write_report_json(K.report_lines(an.summary, an.ttest, an.topics, an.distribution, an.category_source), os.path.join(d, "report"))
    files = [f for f in os.listdir(os.path.join(d, "report")) if f.startswith("part-")]
    assert len(files) == 1
    doc = json.loads(open(os.path.join(d, "report", files[0])).read())
    assert list(doc) == ["prompt_category_source", "metrics_summary", "severity_bias_ttest", "topic_bias_means", "hitl_distribution"]
    assert len(doc["topic_bias_means"]) == an.topics.count() > 2 and set(doc["metrics_summary"][0]) == set(an.summary.columns)
    assert doc["prompt_category_source"] == "question_id"
    assert [m["model"] for m in doc["metrics_summary"]] == ["a", "b"]
    assert doc["severity_bias_ttest"]["tstat"] == 0.0 and doc["severity_bias_ttest"]["pvalue"] == 1.0
    assert all(x["hitl_status"] == "Auto-Approve" for x in doc["hitl_distribution"])
    K.write_csv(an.summary, os.path.join(d, "metrics_summary"))
    assert spark.read.option("header", True).csv(os.path.join(d, "metrics_summary")).count() == 2


def test_report_json_without_results(spark):
    d = _tmp()
    none = lambda schema: spark.createDataFrame([], schema)
    lines = K.report_lines(none("model string, n int"), none("model_1 string"), none("model string, prompt_category string"),
                           none("model string, hitl_status string"), spark.createDataFrame([(None,)], "prompt_category_source string"))
    K.write_report_json(lines, os.path.join(d, "report"))
    assert json.loads("".join(open(os.path.join(d, "report", f)).read() for f in os.listdir(os.path.join(d, "report")) if f.startswith("part-"))) == {
        "prompt_category_source": None, "metrics_summary": [], "severity_bias_ttest": None, "topic_bias_means": [], "hitl_distribution": []}


def test_incremental_stream(spark):
    d = _tmp()
    samples_dir, out_dir = os.path.join(d, "samples"), os.path.join(d, "eval")
    ck, sck = os.path.join(d, "responses_ckpt"), os.path.join(d, "stream_ckpt")
    os.makedirs(samples_dir)

    def write_samples(qid, rows):
        with open(os.path.join(samples_dir, f"question_{qid}_samples.jsonl"), "w") as f:
            for r in rows:
                f.write(json.dumps({"question_id": qid, "question": "Q", "response": f"answer {r}",
                                    "respondent_id": f"p{r}", "row": r}) + "\n")

    write_samples("1", [1, 2, 3])
    q = start_scoring_stream(spark, samples_dir, ["m1", "m2"], out_dir, ck, sck, runs=2, dry_run=True)
    q.awaitTermination(120)
    assert J.read_responses(spark, out_dir).count() == 3 * 2 * 2
    # a new file arrives: only it is scored on the next run
    write_samples("2", [4, 5])
    q = start_scoring_stream(spark, samples_dir, ["m1", "m2"], out_dir, ck, sck, runs=2, dry_run=True)
    q.awaitTermination(120)
    back = J.read_responses(spark, out_dir)
    assert back.count() == 5 * 2 * 2
    assert back.groupBy("model", "run", "sample_row").count().where(F.col("count") > 1).count() == 0


def test_scorer_factory_builds_once_per_partition(spark):
    plan = SC.score_plan(rsp.conversation_samples(spark, SF_SMALL), ["m"], 1).repartition(3)

    def factory():
        client_id = id(object())  # stands for an expensive client built once per partition
        return lambda prompt, model: '{"grammar": 1, "lexical": 1, "coherence": 1, "task": %d}' % (client_id % 7 + 1)

    out = SC.response_records(SC.score(plan, scorer_factory=factory))
    assert out.count() == plan.count()
    assert out.where(F.col("parsed").isNull()).count() == 0


def test_batch_scorer(spark):
    plan = SC.score_plan(rsp.conversation_samples(spark, SF_SMALL), ["m1", "m2"], 2)

    def batch(prompts, models):
        if (models == "m2").all() and len(models) > 10**9:
            raise RuntimeError("never")
        return ['{"grammar": 2, "lexical": 2, "coherence": 2, "task": %d}' % (3 if m == "m1" else 4) for m in models]

    out = SC.response_records(SC.score(plan, batch_scorer=batch))
    got = {r.model: r.parsed.task for r in out.select("model", "parsed").distinct().collect()}
    assert got == {"m1": 3, "m2": 4} and out.count() == plan.count()


def test_dynamic_overwrite_keeps_other_partitions(spark):
    d = _tmp()
    samples = rsp.conversation_samples(spark, SF_SMALL)
    a = SC.response_records(SC.score(SC.score_plan(samples, ["a"], 1), dry_run=True))
    b = SC.response_records(SC.score(SC.score_plan(samples, ["b"], 1), dry_run=True))
    K.write_responses(a, os.path.join(d, "eval"))
    K.write_responses(b, os.path.join(d, "eval"))
    K.write_responses(b, os.path.join(d, "eval"), mode="overwrite")  # replaces b's folders only
    back = J.read_responses(spark, os.path.join(d, "eval"))
    assert back.count() == a.count() + b.count()
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_paths_with_spaces_and_empty_inputs(spark):
    base = os.path.join(_tmp(), "eval run")
    recs = SC.response_records(SC.score(SC.score_plan(rsp.conversation_samples(spark, SF_SMALL), ["a"], 1), dry_run=True))
    K.write_responses(recs, base)
    K.write_checkpoint(recs, os.path.join(base, "check point"))
    back = J.read_responses(spark, base, checkpoint=os.path.join(base, "check point"))
    assert back.count() == recs.count()  # the checkpoint's rows are not counted again
    empty = _tmp()
    with open(os.path.join(empty, "other.jsonl"), "w") as f:
        f.write(json.dumps({"question_id": "q", "response": "no model"}) + "\n")
    with pytest.raises(FileNotFoundError):
        J.read_responses(spark, empty)


def test_samples_folder_is_found(spark):
    d = _tmp()
    os.makedirs(os.path.join(d, "eval", "samples"))
    with open(os.path.join(d, "eval", "samples", "question_1_samples.jsonl"), "w") as f:
        f.write(json.dumps({"question_id": "1"}) + "\n")
    assert J.find_samples(spark, os.path.join(d, "eval")) == os.path.join(d, "eval", "samples")
    os.makedirs(os.path.join(d, "samples"))
    with open(os.path.join(d, "samples", "question_1_samples.jsonl"), "w") as f:
        f.write(json.dumps({"question_id": "1"}) + "\n")
    assert J.find_samples(spark, os.path.join(d, "eval", "x.jsonl")) == os.path.join(d, "samples")
    assert J.find_samples(spark, os.path.join(d, "nowhere", "deep")) is None


def test_reuse_sees_rewritten_files_and_survives_a_crash(spark):
    d, calls = _tmp(), []
    src = os.path.join(d, "in")
    os.makedirs(src)

    def write(text):
        with open(os.path.join(src, "a.jsonl"), "w") as f:
            f.write(text)

    def compute():
        calls.append(1)
        return spark.range(len(calls))

    write("one")
    first = K.input_state(spark, src)
    out = os.path.join(d, "out")
    assert K.reuse_or_compute(spark, out, compute, {"files": first}).count() == 1
    write("other")  # same name, other content
    second = K.input_state(spark, src)
    assert second != first
    # a job that dies after writing data leaves a folder that no manifest line names
    spark.range(99).write.parquet(f"{out}/data-dead")
    assert K.reuse_or_compute(spark, out, compute, {"files": second}).count() == 2
    assert K.reuse_or_compute(spark, out, compute, {"files": first}).count() == 1  # still valid
    assert len(calls) == 2 and K.input_state(spark, os.path.join(d, "missing")) == []


def test_stream_resumes_ids_as_text(spark):
    d = _tmp()
    samples_dir, out_dir = os.path.join(d, "samples"), os.path.join(d, "eval")
    ck = os.path.join(d, "responses_ckpt")
    os.makedirs(samples_dir)
    for k, qid in enumerate(("007", "1.0", "", None)):
        with open(os.path.join(samples_dir, f"question_{k}_samples.jsonl"), "w") as f:
            f.write(json.dumps({"question_id": qid, "question": "Q", "response": "x", "respondent_id": f"p{k}", "row": k + 1}) + "\n")
    for run in range(3):  # fresh stream checkpoints: every file is offered again
        q = start_scoring_stream(spark, samples_dir, ["m"], out_dir, ck, os.path.join(d, f"stream_{run}"), runs=2, dry_run=True)
        q.awaitTermination(120)
        if run == 0:
            # later epochs carry on counting, as a restarted job's would
            for part in os.listdir(ck):
                old = os.path.join(ck, part, "batch=0")
                if os.path.isdir(old):
                    os.rename(old, os.path.join(ck, part, "batch=-1"))
        assert J.read_responses(spark, ck).count() == 4 * 2


def test_pending_plan_equals_the_anti_join(spark):
    samples = rsp.conversation_samples(spark, SF_SMALL)
    plan = SC.score_plan(samples, ["a", "b"], 3)
    done = SC.response_records(SC.score(plan, dry_run=True)).where((F.col("run") == 2) | (F.col("sample_row") % 2 == 0))
    done = done.unionByName(done)  # repeated completions
    cols = ["model", "run", "sample_row", "question_id", "respondent_id", "prompt", "stem", "model_safe"]
    want = SC.pending_requests(plan, done).select(cols)
    got = SC.pending_plan(samples, ["a", "b"], 3, done).select(cols)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert SC.pending_plan(samples, ["a", "b"], 3, None).count() == plan.count()


def test_lines_with_odd_ends(spark):
    good = ['{"grammar":"1"}', ' {"grammar":"2"}\t', '{"grammar":"3"}\x0c', "{'grammar':'4'}", '{"grammar":"5","x":[{"a":{}}]}', '{"grammar":"6, \'x\'","x":{}}', "{}",
            '{"x":{"a":1},"grammar":"8]}"}']
    bad = ['{"grammar":"1"} {"grammar":"2"}', '{"grammar":"1"},{}', '{"grammar":"1"}],"v":[{}', '{"grammar":"1"}]} {}', "{'grammar':'1','x':{}}", '{"x":{}}\x0c', '{"grammar":"1"}}', "[1]", "", "null",
           '{"grammar":"1"', '\x0c{"grammar":"1"}', '{"grammar":"1"},}', '{"grammar":"7"}\u2028', '{"grammar":"1"} x {}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, value string")
    out = {r.i: r.grammar for r in J.parse_jsonl_lines(df, J.SCORES).collect()}
    assert out == dict(enumerate(["1", "2", "3", "4", "5", "6, 'x'", None, "8]}"]))


def test_response_lines_are_parsed_once(spark):
    d = _tmp()
    good = {"model": "m", "run": 1, "sample_row": 3, "question_id": "q1", "respondent_id": "r", "raw": "{}", "parsed": {"grammar": 7, "lexical": 6, "coherence": 5, "task": 4}}
    os.makedirs(os.path.join(d, "check point"))
    for name, run in (("a.jsonl", 1), ("check point/b.json", 2)):
        with open(os.path.join(d, name), "w") as f:
            f.write(json.dumps({**good, "run": run}) + "\n")
    df = align_inputs(J.read_responses(spark, d, checkpoint=os.path.join(d, "check point")), None, source="question_id")
    assert [r.run for r in df.collect()] == [1]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(model,") == 1  # no filter repeats the parse
    # the checkpoint's lines go before the parse, and no line is shuffled for it
    assert plan.index("Generate") < plan.index("LeftAnti") and "rightHint=(strategy=broadcast)" in plan


def test_compressed_responses_are_read_beside_text(spark, monkeypatch):
    monkeypatch.setattr(K, "RECORDS_PER_COMPRESSED_FILE", 40)
    d = _tmp()
    base, ckpt = os.path.join(d, "eval run"), os.path.join(d, "eval run", "check point")
    recs = spark.range(100).coalesce(1).selectExpr(
        "concat('m', id % 2) AS model", "id AS run", "0 AS sample_row", "CAST(id % 2 AS STRING) AS question_id", "'r' AS respondent_id", "'{}' AS raw")
    K.write_jsonl(recs, os.path.join(base, "new"), compression="gzip")
    K.write_jsonl(recs.where("run < 10").withColumn("run", F.col("run") + 100), os.path.join(base, "old"))
    K.write_checkpoint(recs, ckpt, compression="gzip")
    with gzip.open(os.path.join(base, "backup.jsonl.gz"), "wt") as f:  # not a file of Spark's writer
        f.write(json.dumps({"model": "m", "run": 999}) + "\n")
    back = J.read_responses(spark, base, checkpoint=ckpt)
    assert sorted(int(r.run) for r in back.collect()) == list(range(110))
    # a compressed file is read by one task: it ends after so many records
    assert sorted(len(gzip.open(p).readlines()) for p in glob.glob(f"{base}/new/part-*.json.gz")) == [20, 40, 40]
    assert {os.path.basename(r.path) for r in J.response_files(spark, base, ckpt).collect()} == {
        os.path.basename(p) for p in glob.glob(f"{base}/new/part-*.gz") + glob.glob(f"{base}/old/part-*.json")}
    only = os.path.join(d, "only")
    K.write_checkpoint(recs, os.path.join(only, "ckpt"), compression="gzip")
    assert J.read_responses(spark, only, checkpoint=os.path.join(only, "ckpt")).count() == 100
    samples = spark.createDataFrame([("0", "r")], "question_id string, respondent_id string")
    assert J.completed_requests(spark, ckpt, samples, ["m0"]).count() == 50


def _file_query(spark, name):
    """The rows of a query on response files over 2,000 lineitems and 50 parts of its own, and the new folders
    of its files and of its cut."""
    d, kept = _tmp(), ensure_checkpoint_dir(spark).removeprefix("file:").rstrip("/")
    spark.range(2000).selectExpr(
        "id AS l_orderkey", "id % 50 AS l_partkey", "id % 7 AS l_suppkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber",
        "substring('ANR', CAST(id % 3 + 1 AS INT), 1) AS l_returnflag").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    spark.range(50).selectExpr("id AS p_partkey", "concat('name ', id) AS p_name", "concat('type ', id) AS p_type").write.parquet(f"{d}/part.parquet")
    before = set(os.listdir(kept))
    rows = QUERIES[name](spark, d).collect()
    new = sorted(set(os.listdir(kept)) - before)
    one = lambda start: os.path.join(kept, next(x for x in new if x.startswith(start)))
    return rows, one("eval with space-"), one("responses-")


def _small_on_disk(spark, files, cut):
    """Whether both copies of the 2,000 records are whole and take a fifth of their text, and the cut has no texts."""
    for folder in ("run 1", "check point"):
        text = spark.read.option("recursiveFileLookup", "true").text(f"{files}/{folder}")
        n, size = text.agg(F.count(F.lit(1)), F.sum(F.length("value") + 1)).first()
        disk = sum(os.path.getsize(os.path.join(p, f)) for p, _, fs in os.walk(f"{files}/{folder}") for f in fs)
        if n != 2000 or disk * 5 > size:
            return False
    return not {"raw", "response", "parsed"} & set(spark.read.parquet(cut).columns)


def test_file_topic_small_on_disk(spark):
    rows, *folders = _file_query(spark, "file_topic")
    assert _small_on_disk(spark, *folders)
    got = {(r.model, r.run, r.essay_id, r.prompt_category, r.prompt_category_source) for r in rows}
    assert len(rows) == 2000 and got == {
        ("ANR"[i % 3], i % 4 + 1, f"{i % 50}|{i % 50 % 3}|{i % 50}", f"topic{i % 50 % 4}", "topic") for i in range(2000)}
    # defects of l_orderkey % 17: null scores, an error, else four scores; model A has none for part 0
    assert sum(r.total_score is None for r in rows) == sum(i % 17 < 2 or (i % 3 == 0 and i % 50 == 0) for i in range(2000))


def test_file_category_small_on_disk(spark):
    rows, *folders = _file_query(spark, "file_category")
    assert _small_on_disk(spark, *folders)
    got = {(r.model, r.run, r.essay_id, r.prompt_category, r.prompt_question, r.prompt_category_source) for r in rows}
    assert len(rows) == 2000 and got == {
        ("ANR"[i % 3], i % 4 + 1, f"{i % 50}|{i % 50 % 3}|{i % 50}", f"cat{i % 50 % 5}", f"Question {i % 50 % 3}", "category")
        for i in range(2000)}


def test_file_question_id_small_on_disk(spark):
    rows, *folders = _file_query(spark, "file_question_id")
    assert _small_on_disk(spark, *folders)
    got = {(r.model, r.run, r.essay_id, r.prompt_category, r.prompt_question, r.prompt_category_source) for r in rows}
    assert len(rows) == 2000 and got == {
        ("ANR"[i % 3], i % 4 + 1, f"{i % 50}|{i % 50 % 3}|{i % 50}", f"{i % 50 % 3}", None, "question_id") for i in range(2000)}
