"""Report tables on the model summary: distribution, leaderboard, badges.

Inputs are model-grain tables (one row per model). "Best" is a ``min_by`` over an
ordering key (no global window); relative-to-best windows are partitioned by metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterkit.functions.text import short_model_name
from raterkit.session import cut_lineage

# Badge texts and compared metrics.
BADGE_MOST_RELIABLE = "Most Reliable"
BADGE_HIGHEST_SCORE = "Highest Score"
LEADER_METRICS = ["mean_total", "icc_total", "auto-approve"]
QUANTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


def boxplot_summary(essays: DataFrame) -> DataFrame:
    """Exact five-number summary of essay means per model (linear interpolation, (n-1)p).

    Equal values are counted first; the distinct values are then range-partitioned by (model,
    value), and the place of each value in its model follows from sums within its partition and
    of the partitions before it. No task holds all values of a model, and only the few values at
    the wanted places are gathered.
    """
    names = ["q_min", "q1", "median", "q3", "q_max"]
    counted = essays.where(F.col("mean_total").isNotNull()).groupBy("model", F.col("mean_total").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    placed = cut_lineage(counted.repartitionByRange("model", "v").withColumn("part", F.spark_partition_id()), "values")
    sums = placed.groupBy("model", "part").agg(F.sum("c").alias("s"))  # a row per partition and model
    of_model = Window.partitionBy("model")
    earlier = of_model.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "model", "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"), F.sum("s").over(of_model).alias("n")
    )
    within = Window.partitionBy("model", "part").orderBy("v")
    ranked = placed.join(starts, ["model", "part"]).select(
        "model", "v", "n", (F.col("before") + F.sum("c").over(within)).alias("after"), "c"
    )
    first, last = F.col("after") - F.col("c"), F.col("after") - 1  # places of the value, from 0
    ends = []
    for name, q in zip(names, QUANTILES):
        at = (F.col("n") - 1) * F.lit(q)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ends.append(F.max(F.when((first <= place) & (place <= last), F.col("v"))).alias(f"{name}_{side}"))
    found = ranked.groupBy("model").agg(F.max("n").alias("n"), *ends)
    values = []
    for name, q in zip(names, QUANTILES):
        at = (F.col("n") - 1) * F.lit(q)
        part = at - F.floor(at)
        values.append((F.col(f"{name}_lo") + part * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))).alias(name))
    models = essays.groupBy("model").agg(F.count("mean_total").alias("n_scored"))
    return models.join(found.select("model", *values), "model", "left").select("model", "n_scored", *names)


def _q(name: str) -> F.Column:
    return F.col(f"`{name}`")


def _best_first(value: F.Column) -> F.Column:
    """Ordering key whose minimum is the best row: non-null first, larger value first,
    then the first model by name (``idxmax`` semantics)."""
    return F.struct(value.isNull(), -value, F.col("model"))


def leaderboard(summary: DataFrame) -> DataFrame:
    """Best model per metric (largest value; ties go to the first model by name).
    One ``min_by`` aggregate per metric over the model-grain summary."""
    rows = None
    for m in LEADER_METRICS:
        v = _q(m).cast("double")
        best = summary.where(v.isNotNull()).agg(
            F.min_by(F.col("model"), _best_first(v)).alias("best_model"),
            F.min_by(v, _best_first(v)).alias("best_value"),
        ).where(F.col("best_model").isNotNull()).select(F.lit(m).alias("metric"), "best_model", "best_value")
        rows = best if rows is None else rows.unionByName(best)
    return rows.withColumn("best_model_short", short_model_name(F.col("best_model")))


def relative_to_best(summary: DataFrame) -> DataFrame:
    """Each model's metric as a percentage of the best (0 when the best is <= 0), long form."""
    stacked = None
    for m in LEADER_METRICS:
        part = summary.select(F.lit(m).alias("metric"), "model", _q(m).cast("double").alias("value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    w = Window.partitionBy("metric")
    best = F.max("value").over(w)
    ranked = stacked.withColumn(
        "_r", F.row_number().over(Window.partitionBy("metric").orderBy(F.col("value").desc_nulls_last(), "model"))
    )
    return ranked.select(
        "metric", "model", "value",
        F.when(best > 0, F.col("value") / best * 100.0).otherwise(F.lit(0.0)).alias("pct_of_best"),
        ((F.col("_r") == 1) & F.col("value").isNotNull()).alias("is_best"),
    )


def badges(summary: DataFrame) -> DataFrame:
    """Most reliable (best ICC) else highest score (best mean) per model."""
    lb = leaderboard(summary)
    best_icc = lb.where(F.col("metric") == "icc_total").select(F.col("best_model").alias("_icc"))
    best_mean = lb.where(F.col("metric") == "mean_total").select(F.col("best_model").alias("_mean"))
    s = summary.select("model")
    s = s.join(best_icc, s["model"] == best_icc["_icc"], "left").join(best_mean, s["model"] == best_mean["_mean"], "left")
    return s.select(
        "model",
        F.when(F.col("_icc").isNotNull(), F.lit(BADGE_MOST_RELIABLE))
        .when(F.col("_mean").isNotNull(), F.lit(BADGE_HIGHEST_SCORE))
        .alias("badge"),
        short_model_name(F.col("model")).alias("model_short"),
    )


def exec_summary(summary: DataFrame) -> DataFrame:
    """Models compared, total essays, mean auto-approve %, most reliable model and its ICC."""
    key = _best_first(F.col("icc_total").cast("double"))
    return summary.agg(
        F.count(F.lit(1)).alias("n_models"),
        F.sum("n_essays").cast("long").alias("total_essays"),
        F.avg(_q("auto-approve")).alias("avg_auto_approve"),
        short_model_name(F.min_by(F.col("model"), key)).alias("most_reliable"),
        F.min_by(F.col("icc_total"), key).alias("most_reliable_icc"),
    )
