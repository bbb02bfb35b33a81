"""Hot keys: one essay, model, question or duplicated text holding a third of all rows.

Results must stay whole and exact, and the heavy aggregations must be partial (map-side)
before their shuffle, so the hot key is reduced before it reaches one task.
"""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raterkit.operators import clean, metrics, sample
from raterkit.operators.align import align_inputs
from raterkit.operators.icc import icc_by_model


def _aligned(spark, rows):
    df = spark.createDataFrame(rows, "model string, respondent_id string, run int, total double")
    df = df.select("model", "respondent_id", F.lit("q").alias("question_id"), F.lit("1").alias("sample_row"),
                   "run", F.col("total").alias("total_score"), F.lit(None).cast("string").alias("raw"))
    return align_inputs(df, None, source="question_id").repartition(6)


def test_hot_essay_metrics_exact(spark):
    rng = np.random.default_rng(11)
    rows = [("m", f"e{i}", r, float(rng.integers(10, 30))) for i in range(300) for r in (1, 2)]
    hot = [("m", "hot", int(rng.integers(1, 4)), float(rng.integers(10, 30))) for _ in range(300)]  # a third
    rows += hot
    aligned = _aligned(spark, rows)
    essays = metrics.essay_metrics(aligned)
    got = {r.respondent_id: r for r in essays.collect()}
    pdf = pd.DataFrame(rows, columns=["model", "e", "run", "t"])
    exp = pdf.groupby("e")["t"].agg(["mean", "std", "min", "max", "count"])
    assert len(got) == 301
    for e, row in exp.iterrows():
        r = got[e]
        assert r.mean_total == pytest.approx(row["mean"]) and r.n_runs == row["count"]
        assert r.sd_total == pytest.approx(0.0 if np.isnan(row["std"]) else row["std"])
    plan = essays._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_avg") > plan.index("Exchange hashpartitioning(model")  # partial below the shuffle


def test_hot_model_icc_exact(spark):
    rng = np.random.default_rng(5)
    rows, mats = [], {}
    for model, n in [("big", 200), ("small", 20)]:
        mat = rng.integers(10, 30, size=(n, 1)) + rng.integers(-2, 3, size=(n, 4))
        mats[model] = mat.astype(float)
        rows += [(model, f"e{i}", r + 1, float(mat[i, r])) for i in range(n) for r in range(4)]
    out = {r.model: r for r in icc_by_model(_aligned(spark, rows)).collect()}
    for model, mat in mats.items():
        n, k = mat.shape
        g = mat.mean()
        ssb = k * ((mat.mean(1) - g) ** 2).sum()
        ssc = n * ((mat.mean(0) - g) ** 2).sum()
        sse = ((mat - g) ** 2).sum() - ssb - ssc
        msb, mse = ssb / (n - 1), sse / ((n - 1) * (k - 1))
        assert out[model].icc_total == pytest.approx((msb - mse) / (msb + (k - 1) * mse), abs=1e-12)


def test_hot_duplicate_text_dedupe(spark):
    text = " ".join(["word"] * 50)
    rows = [(i + 1, text if i % 3 == 0 else f"{text} {i}", "q1") for i in range(900)]  # a third identical
    answers = spark.createDataFrame(rows, "row long, textResponse string, questionId string").repartition(7)
    recs = clean.clean_records(answers, dedupe=True)
    assert recs.count() == 1 + 600
    kept_hot = recs.where(F.col("response") == text).collect()
    assert [r.row for r in kept_hot] == [1]  # the first occurrence
    counters = clean.clean_counters(answers, dedupe=True).first()
    assert (counters.deduped, counters.kept) == (299, 601)


def test_hot_question_sample(spark):
    text = " ".join(["word"] * 45)
    rows = [(i + 1, f"{text} {i}", "hot" if i < 300 else f"q{i % 30}") for i in range(900)]
    answers = spark.createDataFrame(rows, "row long, textResponse string, questionId string").repartition(7)
    qs = spark.createDataFrame([("hot",), ("q1",)], "question_id string")
    s = sample.sample_per_question(answers, qs, n=25)
    counts = {r.question_id: r["count"] for r in s.groupBy("question_id").count().collect()}
    assert counts == {"hot": 25, "q1": 20}
    ranks = sorted(r.sample_rank for r in s.where("question_id = 'hot'").collect())
    assert ranks == list(range(1, 26))
