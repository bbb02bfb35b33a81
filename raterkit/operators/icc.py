"""ICC(3,1) per model over balanced essays.

Two-way mixed, consistency, single rater; targets = essays, raters = runs.
With n balanced essays, k runs, cells x, essay means m_e, run means m_r and
grand mean g:

    SSB = k * sum_e (m_e - g)^2          MSB = SSB / (n - 1)
    SSW = sum (x - m_e)^2                (within essays)
    SSC = n * sum_r (m_r - g)^2          (between runs)
    SSE = SSW - SSC                      MSE = SSE / ((n - 1)(k - 1))
    ICC = (MSB - MSE) / (MSB + (k - 1) MSE)

Plan (one scan, no join back to it):

1. A2: duplicate runs collapse with a partial aggregate on (model, essay, run);
   afterwards an essay has at most k rows, so the essay window is bounded.
2. Window over (model, essay): its number of scored runs and its mean.
3. One aggregate on (model, run, number of scored runs): an essay is balanced when that
   number is the model's k, and in a balanced design every essay has exactly one cell per
   run, so each run's group sees all n essay means (their population variance gives SSB)
   plus the run mean and the within-essay squares.
4. On that table of at most k * k rows per model: k, and one aggregate per model.

Cells written in buckets by (model, essay) (``operators.cells``) need no exchange for 1 and 2.

Every variance is a centred, numerically stable Spark aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapse_runs(aligned: DataFrame) -> DataFrame:
    """A2: mean total per (model, essay, run); NULL where no response of the run is scored."""
    return aligned.groupBy("model", "essay_id", "run").agg(F.avg("total_score").alias("x"))


ICC_COUNTS = ["icc_n_essays_total", "icc_n_essays_balanced", "icc_n_raters"]


def icc_of_runs(runs: DataFrame) -> DataFrame:
    """M1 from collapsed runs (``model, essay_id, run, x``): model, icc_total and ``ICC_COUNTS``.

    ICC is NULL when k < 2, n < 2 or the denominator is 0; a model without scores has counts 0.
    """
    essay = Window.partitionBy("model", "essay_id")
    scored = F.col("x").isNotNull()
    cells = runs.withColumns({
        "n_e": F.count("x").over(essay),
        "m_e": F.avg("x").over(essay),
        "first_of_essay": F.coalesce(F.col("run") == F.min(F.when(scored, F.col("run"))).over(essay), F.lit(False)),
    })
    per_run = cells.groupBy("model", "run", "n_e").agg(
        F.sum(F.col("first_of_essay").cast("long")).alias("essays"),
        F.count("x").alias("n"),
        F.avg("x").alias("m_r"),
        F.var_pop(F.when(scored, F.col("m_e"))).alias("var_e"),
        F.sum((F.col("x") - F.col("m_e")) ** 2).alias("ssw"),
    )
    scored_runs = F.collect_set(F.when(F.col("n") > 0, F.col("run"))).over(Window.partitionBy("model"))
    per_run = per_run.withColumn("k", F.size(scored_runs).cast("long"))
    bal = (F.col("n_e") == F.col("k")) & (F.col("n") > 0)
    per_model = per_run.groupBy("model").agg(
        F.sum("essays").alias("icc_n_essays_total"),
        F.coalesce(F.sum(F.when(bal, F.col("essays"))), F.lit(0)).alias("icc_n_essays_balanced"),
        F.max("k").alias("icc_n_raters"),
        F.max(F.when(bal, F.col("n"))).alias("n"),
        F.max(F.when(bal, F.col("var_e"))).alias("var_e"),
        F.var_pop(F.when(bal, F.col("m_r"))).alias("var_r"),
        F.sum(F.when(bal, F.col("ssw"))).alias("ssw"),
    )
    k = F.col("icc_n_raters").cast("double")
    n = F.col("n").cast("double")
    ssb = k * n * F.col("var_e")
    ssc = n * k * F.col("var_r")
    sse = F.col("ssw") - ssc
    msb = ssb / (n - 1.0)
    mse = sse / ((n - 1.0) * (k - 1.0))
    denom = msb + (k - 1.0) * mse
    icc = F.when((k >= 2) & (n >= 2) & (denom != 0), (msb - mse) / denom)
    return per_model.select("model", icc.alias("icc_total"), *[F.col(c).cast("long").alias(c) for c in ICC_COUNTS])


def icc_stats(aligned: DataFrame) -> DataFrame:
    """``icc_of_runs`` of aligned responses."""
    return icc_of_runs(collapse_runs(aligned))


def with_counts(df: DataFrame) -> DataFrame:
    """Counts of models without scores are 0."""
    return df.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ICC_COUNTS})


def icc_by_model(aligned: DataFrame) -> DataFrame:
    """M1: model, icc_total, icc_n_essays_total, icc_n_essays_balanced, icc_n_raters.

    Every model of the input appears; one without scores has counts 0 and NULL ICC.
    """
    return icc_stats(aligned.where(F.col("model").isNotNull()))
