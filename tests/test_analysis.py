"""Statistics: essay metrics vectors, ICC vs a NumPy two-way ANOVA, t-test/p-value goldens, routing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterkit.functions.stats import student_t_two_sided_p
from raterkit.operators import bias, metrics
from raterkit.operators.align import align_inputs
from raterkit.operators.icc import icc_by_model
from raterkit.plans.analysis import Analysis


def _responses(spark, rows):
    """rows: (model, essay, run, total or None) -> aligned responses with that total."""
    df = spark.createDataFrame(rows, "model string, respondent_id string, run int, total double")
    df = df.select(
        "model", "respondent_id", F.lit("q").alias("question_id"), F.lit("1").alias("sample_row"), "run",
        F.col("total").alias("total_score"), F.lit(None).cast("string").alias("raw"),
    )
    return align_inputs(df, None, source="question_id")


def test_essay_metric_vectors(spark):
    cases = {
        "a": [28, 28, 28], "b": [20, 22], "c": [20, 23], "d": [5, 7], "e": [30], "f": [None, None], "g": [0, 0],
    }
    rows = [("m", k, i + 1, None if v is None else float(v)) for k, vs in cases.items() for i, v in enumerate(vs)]
    routed = metrics.apply_hitl(metrics.essay_metrics(_responses(spark, rows)))
    got = {r.respondent_id: r for r in routed.collect()}
    exp = {  # mean, sd, range, cv, n_runs, status
        "a": (28, 0, 0, 0, 3, "Auto-Approve"), "b": (21, 1.41421, 2, 0.06734, 2, "Auto-Approve"),
        "c": (21.5, 2.12132, 3, 0.09867, 2, "Flagged for Review"), "d": (6, 1.41421, 2, 0.23570, 2, "Flagged for Review"),
        "e": (30, 0, 0, 0, 1, "Auto-Approve"), "f": (None, 0, 0, 0, 0, "Auto-Approve"), "g": (0, 0, 0, 0, 2, "Auto-Approve"),
    }
    for k, (mean, sd, rng, cv, n, st) in exp.items():
        r = got[k]
        assert (r.mean_total is None) == (mean is None)
        if mean is not None:
            assert r.mean_total == pytest.approx(mean)
        assert r.sd_total == pytest.approx(sd, abs=1e-5)
        assert r.range_total == pytest.approx(rng)
        assert r.cv_total == pytest.approx(cv, abs=1e-5)
        assert r.n_runs == n and r.hitl_status == st


def test_cv_threshold_exact(spark):
    # 17, 20, 23: sd = 3, mean = 20 -> cv = 0.15 exactly -> not below the threshold
    rows = [("m", "x", i + 1, float(v)) for i, v in enumerate([17, 20, 23])]
    r = metrics.apply_hitl(metrics.essay_metrics(_responses(spark, rows))).first()
    assert r.hitl_status == "Flagged for Review"


def _anova_icc3(mat):
    n, k = mat.shape
    g = mat.mean()
    ssb = k * ((mat.mean(axis=1) - g) ** 2).sum()
    ssc = n * ((mat.mean(axis=0) - g) ** 2).sum()
    sst = ((mat - g) ** 2).sum()
    sse = sst - ssb - ssc
    msb, mse = ssb / (n - 1), sse / ((n - 1) * (k - 1))
    return (msb - mse) / (msb + (k - 1) * mse)


def test_icc_matches_numpy_anova(spark):
    rng = np.random.default_rng(7)
    rows, mats = [], {}
    for model, n, k in [("m1", 40, 5), ("m2", 25, 3)]:
        mat = rng.integers(10, 36, size=(n, 1)) + rng.integers(-3, 4, size=(n, k))
        mats[model] = mat.astype(float)
        for e in range(n):
            for r in range(k):
                rows.append((model, f"e{e}", r + 1, float(mat[e, r])))
    # unbalanced extras: an essay missing a run, a duplicated run (collapsed by mean), an unscored row
    rows += [("m1", "extra", 1, 20.0), ("m1", "e0", 1, float(mats["m1"][0, 0])), ("m2", "e0", 1, None)]
    out = {r.model: r for r in icc_by_model(_responses(spark, rows)).collect()}
    assert out["m1"].icc_total == pytest.approx(_anova_icc3(mats["m1"]), abs=1e-12)
    assert out["m2"].icc_total == pytest.approx(_anova_icc3(mats["m2"]), abs=1e-12)
    assert (out["m1"].icc_n_essays_total, out["m1"].icc_n_essays_balanced, out["m1"].icc_n_raters) == (41, 40, 5)
    assert (out["m2"].icc_n_essays_total, out["m2"].icc_n_essays_balanced, out["m2"].icc_n_raters) == (25, 25, 3)


def test_icc_degenerate_and_unscored_model(spark):
    rows = [("m", f"e{i}", r, 28.0) for i in range(3) for r in (1, 2)] + [("z", "e0", 1, None)]
    out = {r.model: r for r in icc_by_model(_responses(spark, rows)).collect()}
    assert out["m"].icc_total is None  # zero variance: denominator 0
    assert (out["z"].icc_total, out["z"].icc_n_essays_total, out["z"].icc_n_raters) == (None, 0, 0)


def test_published_pvalue(spark):
    df = spark.createDataFrame([(-7.425318964294233, 94.0)], "t double, df double")
    p = df.select(student_t_two_sided_p(F.col("t"), F.col("df"))).first()[0]
    assert p == pytest.approx(5.0305091298059116e-11, rel=1e-12)


def test_pvalue_against_closed_forms(spark):
    # df = 1: Cauchy, p = 1 - 2 atan(|t|)/pi; df = 2: p = 1 - |t| / sqrt(2 + t^2)
    ts = [0.1, 0.5, 1.0, 2.0, 5.0, 30.0]
    df = spark.createDataFrame([(t,) for t in ts], "t double")
    p1 = [r[0] for r in df.select(student_t_two_sided_p(F.col("t"), F.lit(1.0))).collect()]
    p2 = [r[0] for r in df.select(student_t_two_sided_p(F.col("t"), F.lit(2.0))).collect()]
    for t, a, b in zip(ts, p1, p2):
        assert a == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-11)
        assert b == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-11)


def test_ttest_and_bland_altman(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(25, 5, 60).round(1)
    b = (a + rng.normal(2, 1.5, 60)).round(1)
    rows = [("rater-a", f"e{i}", 1, float(x)) for i, x in enumerate(a)] + [("rater-b", f"e{i}", 1, float(x)) for i, x in enumerate(b)]
    rows += [("rater-a", "only_a", 1, 10.0), ("zzz", "e0", 1, 1.0)]  # unpaired essay, third model ignored
    an = Analysis(_responses(spark, rows))
    t = an.ttest.first()
    d = a - b
    t_exp = d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))
    assert (t.model_1, t.model_2, t.n_pairs) == ("rater-a", "rater-b", 60)
    assert t.tstat == pytest.approx(t_exp, rel=1e-12)
    ba = an.bland_altman.first()
    assert ba.bias == pytest.approx(d.mean(), abs=1e-12)
    assert ba.loa_upper - ba.bias == pytest.approx(1.96 * d.std(ddof=1), rel=1e-12)
    assert ba.bias - ba.loa_lower == pytest.approx(ba.loa_upper - ba.bias, rel=1e-12)


def test_degenerate_ttest(spark):
    rows = [("a", "e1", 1, 20.0), ("b", "e1", 1, 22.0), ("a", "e2", 1, 25.0), ("b", "e2", 1, 27.0)]
    t = Analysis(_responses(spark, rows)).ttest.first()
    assert (t.tstat, t.pvalue, t.degenerate) == (0.0, 1.0, True)
    one = Analysis(_responses(spark, [("a", "e1", 1, 20.0)]))
    assert one.ttest.count() == 0


def test_distribution_sums_to_100(spark):
    rows = [("m", f"e{i}", r, float(20 + (i * r) % 7)) for i in range(30) for r in (1, 2, 3)]
    an = Analysis(_responses(spark, rows))
    tot = an.distribution.groupBy("model").agg(F.sum("pct").alias("s")).first().s
    assert tot == pytest.approx(100.0)
    s = an.summary.first()
    assert s["auto-approve"] + s["flagged_for_review"] == pytest.approx(100.0)


def test_topic_delta_uses_unweighted_topic_average(spark):
    df = spark.createDataFrame(
        [("m", "t1", 10.0), ("m", "t1", 20.0), ("m", "t1", 30.0), ("m", "t2", 40.0)],
        "model string, prompt_category string, mean_total double")
    d = {r.prompt_category: r.delta_vs_topic_avg for r in bias.topic_delta(bias.topic_means(df)).collect()}
    assert d == {"t1": pytest.approx(-10.0), "t2": pytest.approx(10.0)}


def test_bland_altman_golden_finalisation(spark):
    """Published: bias -2.07, limits -7.38 / +3.25 on 95 pairs -> sd 2.7117, t -7.44."""
    n, bias_, sd = 95, -2.07, (3.25 + 7.38) / (2 * 1.96)
    z = np.linspace(-1.0, 1.0, n)
    d = bias_ + sd * (z - z.mean()) / z.std(ddof=1)  # exact mean and sample sd
    rows = [("a", f"e{i}", 1, 25.0 + float(x)) for i, x in enumerate(d)] + [("b", f"e{i}", 1, 25.0) for i in range(n)]
    an = Analysis(_responses(spark, rows))
    ba = an.bland_altman.first()
    # the published values are each rounded to 2 places
    assert ba.n_pairs == 95
    assert (ba.bias, ba.loa_lower, ba.loa_upper) == (pytest.approx(-2.07, abs=0.01), pytest.approx(-7.38, abs=0.01),
                                                     pytest.approx(3.25, abs=0.01))
    t = an.ttest.first()
    assert round(t.tstat, 2) == -7.44 and t.pvalue < 1e-9


def test_resume_identity(spark):
    from conftest import SF_SMALL
    from raterkit.operators import scoring as SC
    from raterkit.plans import responses as rsp

    plan = SC.score_plan(rsp.conversation_samples(spark, SF_SMALL), ["m1", "m2"], 3)
    done = SC.response_records(SC.score(plan.where(F.col("run") != 2), dry_run=True))
    pending = SC.pending_requests(plan, done)
    assert pending.count() + done.count() == plan.count()
    assert pending.where(F.col("run") != 2).count() == 0


def test_pvalue_large_df_tends_to_normal(spark):
    ts = [0.5, 1.5, 1.75, 2.0, 3.0]
    df = spark.createDataFrame([(t,) for t in ts], "t double")
    ps = [r[0] for r in df.select(student_t_two_sided_p(F.col("t"), F.lit(1e8))).collect()]
    for t, p in zip(ts, ps):
        assert p == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-6)


def test_boxplot_exact(spark):
    from raterkit.operators.report import boxplot_summary

    vals = [float(v) for v in range(1, 101)]
    df = spark.createDataFrame([("m", v) for v in vals], "model string, mean_total double")
    ex = boxplot_summary(df).first()
    assert (ex.q_min, ex.q1, ex.median, ex.q3, ex.q_max) == (1.0, 25.75, 50.5, 75.25, 100.0)  # (n-1)p rule


def test_boxplot_ties_single_values_and_unscored(spark):
    from raterkit.operators.report import boxplot_summary

    rows = [("a", 5.0)] * 7 + [("a", 1.0), ("a", None), ("b", 3.0), ("c", None)]
    out = {r.model: r for r in boxplot_summary(spark.createDataFrame(rows, "model string, mean_total double")).collect()}
    assert (out["a"].n_scored, out["a"].q_min, out["a"].q1, out["a"].q_max) == (8, 1.0, 5.0, 5.0)
    assert (out["b"].q_min, out["b"].median, out["b"].q_max) == (3.0, 3.0, 3.0)
    assert (out["c"].n_scored, out["c"].median) == (0, None)


def test_topic_matrix_explicit_categories(spark):
    t = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)],
                              "model string, prompt_category string, topic_mean double")
    m = {r.model: r for r in bias.topic_matrix(t, ["x", "y", "z"]).collect()}
    assert (m["a"].x, m["a"].y, m["a"].z, m["b"].x, m["b"].y) == (1.0, 2.0, None, 3.0, None)


def test_essay_question_detection_branches(spark):
    from raterkit.operators.sample import detect_essay_questions

    rows = [(1, "q1", "Essay Writing", "text"), (2, "q2", "multiple choice", "a"), (3, "q3", "WRITING task", "b"),
            (4, "q2", "multiple choice", "c")]
    df = spark.createDataFrame(rows, "row long, questionId string, questionType string, textResponse string")
    assert sorted(r[0] for r in detect_essay_questions(df).collect()) == ["q1", "q3"]
    none = df.withColumn("questionType", F.lit("choice"))
    # no essay type: the most answered questions (ties by id)
    assert [r[0] for r in detect_essay_questions(none, n=2).collect()] == ["q2", "q1"]


def test_parse_failure_rate_counts(spark):
    rows = [
        ("m", "1", "1", "q", "e1", '{"grammar": 12, "lexical": 1, "coherence": 1, "task": 1}'),  # out of range, scored
        ("m", "2", "1", "q", "e1", "ERROR: timeout"),                                               # error, unscored
        ("m", "1", "2", "q", "e2", "no digits here"),                                               # essay never scored
        ("n", "1", "1", "q", "e1", '{"grammar": 1, "lexical": 1, "coherence": 1, "task": 1}'),
    ]
    from raterkit.functions.parse import parse_scores
    df = spark.createDataFrame(rows, "model string, run string, sample_row string, question_id string, "
                                     "respondent_id string, raw string").withColumn("parsed", parse_scores("raw"))
    r = {x.model: x for x in metrics.parse_failure_rate(align_inputs(df, None, source="question_id")).collect()}
    m = r["m"]
    assert (m.submitted, m.valid, m.failed, m.responses, m.error_responses, m.out_of_range_responses) == (2, 1, 1, 3, 1, 1)
    assert m.failed_pct == pytest.approx(50.0)
    assert (r["n"].submitted, r["n"].failed, r["n"].out_of_range_responses) == (1, 0, 0)


def _fisher_p(t, n):
    """Two-sided p for many degrees of freedom: the normal tail and two terms of its expansion in 1/n."""
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    return math.erfc(t / math.sqrt(2)) + 2 * density * ((t**3 + t) / (4 * n) + (3 * t**7 - 7 * t**5 - 5 * t**3 - 3 * t) / (96 * n * n))


def test_pvalue_for_many_degrees_of_freedom(spark):
    cases = [(t, n) for n in (1e8, 1e12, 1e15) for t in (0.001, 0.5, 1.0, 2.9, 3.1, 6.0, 9.0)] + [(1.0, 2e5), (0.3, 1e5)]
    df = spark.createDataFrame(cases, "t double, n double")
    for r in df.select("t", "n", student_t_two_sided_p(F.col("t"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(_fisher_p(r.t, r.n), rel=1e-11), (r.t, r.n)
    # the two methods meet
    near = spark.createDataFrame([(t, n) for t in (0.5, 2.0, 8.0, 30.0) for n in (99_999.0, 100_000.0)], "t double, n double")
    rows = near.select("t", "n", student_t_two_sided_p(F.col("t"), F.col("n")).alias("p")).orderBy("t", "n").collect()
    for a, b in zip(rows[::2], rows[1::2]):
        slope = a.t * (a.t**2 + 1) / 4 / 99_999.0**2 * 2  # the p-value itself changes a little from one n to the next
        assert a.p == pytest.approx(b.p, rel=1e-9 + slope * (1 + a.t))


def test_all_pairs_equal_the_single_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(m, f"e{i}", r + 1, None if (m, i) == ("b", 3) else float(rng.integers(0, 30))) for m in "abcd" for i in range(12 if m != "d" else 1) for r in (0, 1)]
    scores = metrics.essay_scores(_responses(spark, rows))
    tests = {(r.model_1, r.model_2): r for r in bias.severity_ttest_all(scores).collect()}
    limits = {(r.model_1, r.model_2): r for r in bias.bland_altman_all(scores).collect()}
    names = ["a", "b", "c", "d"]
    assert set(tests) == set(limits) == {(x, y) for i, x in enumerate(names) for y in names[i + 1 :]}
    for pair in tests:
        one = bias.severity_ttest(scores, names=pair).first()
        assert (tests[pair].n_pairs, tests[pair].degenerate) == (one.n_pairs, one.degenerate)
        assert tests[pair].tstat == pytest.approx(one.tstat) and tests[pair].pvalue == pytest.approx(one.pvalue)
        assert limits[pair].bias == pytest.approx(bias.bland_altman(scores, names=pair).first().bias)
    plan = bias.severity_ttest_all(scores)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(essay_id") == 1
    assert bias.severity_ttest_all(scores.where("model = 'a'")).count() == 0
