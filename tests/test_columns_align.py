"""Column resolution (P1/P2), category source and prompt text (P10/P11), JSONL writer."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from raterkit.operators.align import align_inputs, category_source
from raterkit.operators.columns import CANDIDATES, find_column, resolve_columns
from raterkit.sources import jsonl as J
from raterkit.sources.sinks import write_jsonl
from conftest import SF_SMALL


def test_find_column_rules():
    cands = CANDIDATES["response"]
    assert find_column(["id", "TextResponse"], cands) == "TextResponse"           # exact, case-insensitive
    assert find_column(["my_answer_text", "x"], cands) == "my_answer_text"        # substring
    assert find_column(["Response", "response"], cands) == "response"             # last of equal names wins
    assert find_column(["essay_answer", "final_response"], cands) == "final_response"  # candidate-major order
    assert find_column(["a", "b"], cands) is None
    r = resolve_columns(["answer", "prompt", "examType", "participant"], question_col="prompt")
    assert r == {"response": "answer", "question": "prompt", "type": "examType", "respondent": "participant"}


def _base(spark, extra_cols=""):
    cols = "model string, run string, sample_row string, question_id string, respondent_id string, raw string"
    return cols + extra_cols


def test_category_source_and_prompt_text(spark):
    raw = '{"grammar": 1, "lexical": 2, "coherence": 3, "task": 4}'
    rows = [("m", "1", "5", "q1", "r", raw, "cat-a", "topic-a", "Q text")]
    df = spark.createDataFrame(rows, _base(spark, ", category string, topic string, question string"))
    a = align_inputs(df, None)
    r = a.first()
    assert (r.prompt_category_source, r.prompt_category, r.prompt_question) == ("category", "cat-a", "Q text")
    assert r.total_score == 10.0 and r.essay_id == "r|q1|5" and r.run == 1
    t = align_inputs(df.drop("category"), None).first()
    assert (t.prompt_category_source, t.prompt_category) == ("topic", "topic-a")
    q = align_inputs(df.drop("category", "topic", "question"), None).first()
    assert (q.prompt_category_source, q.prompt_category, q.prompt_question) == ("question_id", "q1", None)
    # a map whose categories are all NULL does not win
    m = spark.createDataFrame([("q1", None, "mapped Q")], "question_id string, prompt_category string, prompt_question string")
    s = category_source(df, m).first()[0]
    assert s == "category"
    m2 = spark.createDataFrame([("q1", "mapped", "mapped Q")], "question_id string, prompt_category string, prompt_question string")
    w = align_inputs(df, m2).first()
    assert (w.prompt_category_source, w.prompt_category, w.prompt_question) == ("samples.category", "mapped", "mapped Q")


def test_unmapped_and_null_ids(spark):
    raw = '{"grammar": 1, "lexical": 2, "coherence": 3, "task": 4}'
    rows = [("m", None, None, None, None, raw), (None, "1", "1", "q", "r", raw)]
    df = spark.createDataFrame(rows, _base(spark))
    m = spark.createDataFrame([("zz", "c", "Q")], "question_id string, prompt_category string, prompt_question string")
    out = align_inputs(df, m, source="samples.category").collect()
    assert len(out) == 1  # the model-less row is dropped
    r = out[0]
    assert (r.essay_id, r.run, r.prompt_category) == ("||", 0, "unknown")


def test_write_jsonl_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="raterkit-test-")
    df = spark.createDataFrame([("é ü", None, 3)], "a string, b string, c int")
    write_jsonl(df, os.path.join(d, "out"))
    files = [f for f in os.listdir(os.path.join(d, "out")) if f.endswith(".json")]
    lines = [json.loads(x) for f in files for x in open(os.path.join(d, "out", f), encoding="utf-8")]
    assert lines == [{"a": "é ü", "b": None, "c": 3}]
    back = J.read_jsonl(spark, os.path.join(d, "out"), J.SCORES)
    assert back.count() == 1
    assert back.select(F.col("grammar")).first()[0] is None


def test_tolerant_line_rules(spark):
    d = tempfile.mkdtemp(prefix="raterkit-test-")
    with open(os.path.join(d, "x.jsonl"), "w") as f:
        f.write('{"grammar": "1"}\n\n   \n{"grammar": "2"} trailing\n[1]\n7\n{broken\n  {"grammar": 3}  \n')
    got = sorted(r.grammar for r in J.read_jsonl(spark, d, J.SCORES).collect())
    assert got == ["1", "3"]
    assert J.read_jsonl(spark, d, J.SCORES).count() == 2


def test_select_samples_by_name_first_files_and_per_question(spark):
    from raterkit.operators.sample import select_samples

    rows = [(q, r, k) for q in ("1", "10", "2") for k, r in enumerate(range(5), start=1)]
    s = spark.createDataFrame(rows, "question_id string, row long, sample_rank long")
    by_name = select_samples(s, names=["question_2_samples.jsonl"])
    assert {r.question_id for r in by_name.collect()} == {"2"}
    # file names sort as a listing would: question_10_ < question_1_ < question_2_
    first2 = select_samples(s, max_questions=2, per_question=3)
    got = sorted((r.question_id, r.sample_rank) for r in first2.collect())
    assert got == [("1", 1), ("1", 2), ("1", 3), ("10", 1), ("10", 2), ("10", 3)]


def test_read_answers_json_with_ordinal_column(spark):
    from raterkit.sources.answers import read_answers

    d = tempfile.mkdtemp(prefix="raterkit-test-")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('{"n": 7, "textResponse": "x"}\n{"n": 3, "textResponse": "y"}\n')
    df = read_answers(spark, os.path.join(d, "a.json"), fmt="json", row_col="n")
    assert sorted((r.row, r.textResponse) for r in df.collect()) == [(3, "y"), (7, "x")]


def test_scan_partitions_only_when_asked(spark):
    from raterkit.plans.tables import SCAN_PARTITIONS, table

    assert "Exchange" not in table(spark, SF_SMALL, "documents")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(SCAN_PARTITIONS, "5")
    try:
        assert "RoundRobinPartitioning(5)" in table(spark, SF_SMALL, "documents")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(SCAN_PARTITIONS)


def test_map_without_a_match_does_not_win(spark):
    raw = '{"grammar": 1, "lexical": 2, "coherence": 3, "task": 4}'
    df = spark.createDataFrame([("m", "1", "5", "q1", "r", raw, "own")], _base(spark, ", category string"))
    other = spark.createDataFrame([("q9", "mapped", "Q")], "question_id string, prompt_category string, prompt_question string")
    r = align_inputs(df, other).first()
    assert (r.prompt_category_source, r.prompt_category) == ("category", "own")
    # a declared column without any value counts as absent
    empty = df.withColumns({c: F.lit(None).cast("string") for c in ("prompt_category", "topic", "prompt_question")})
    m = spark.createDataFrame([("q1", "mapped", "Q")], "question_id string, prompt_category string, prompt_question string")
    r = align_inputs(empty, m).first()
    assert (r.prompt_category_source, r.prompt_category, r.prompt_question) == ("samples.category", "mapped", "Q")


def test_essay_key_is_unique_when_attributes_differ(spark):
    from raterkit.operators import metrics

    rows = [("m", "r|q|1", 1, 2.0, "r", "P1"), ("m", "r|q|1", 2, 10.0, "r", None), ("m", "|q|1", 1, 5.0, None, None), ("m", "|q|1", 2, 5.0, "", "P2")]
    df = spark.createDataFrame(rows, "model string, essay_id string, run int, total_score double, respondent_id string, prompt_category string")
    out = {r.essay_id: r for r in metrics.essay_metrics(df).collect()}
    assert len(out) == 2 and metrics.essay_metrics(df).count() == 2
    assert (out["r|q|1"].range_total, out["r|q|1"].prompt_category, out["r|q|1"].n_runs) == (8.0, "P1", 2)
    assert (out["|q|1"].respondent_id, out["|q|1"].prompt_category) == ("", "P2")
    assert metrics.apply_hitl(metrics.essay_metrics(df)).where("essay_id = 'r|q|1'").first().hitl_status == metrics.FLAGGED


def test_prompt_map_join_deals_no_response_by_question(spark):
    from raterkit.operators.align import sample_map
    from raterkit.operators.metrics import attach_prompts

    responses = spark.createDataFrame([("m", i, "7", f"q{i % 2}", str(i)) for i in range(6)], "model string, run int, sample_row string, question_id string, respondent_id string")
    responses = responses.withColumns({"raw": F.lit("x"), "total_score": F.lit(1.0)})
    samples = spark.createDataFrame([("q0", "c", "Q", 2), ("q0", "b", "P", 1), ("q2", "d", "R", 3)], "question_id string, category string, question string, row int")
    a = align_inputs(responses, sample_map(samples), source="samples.category")
    essays = attach_prompts(responses, sample_map(samples))
    for df in (a, essays):
        assert {(r.question_id, r.prompt_category) for r in df.select("question_id", "prompt_category").collect()} == {("q0", "b"), ("q1", "unknown")}
    for df in (a, attach_prompts(responses, sample_map(samples))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
