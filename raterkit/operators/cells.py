"""Mergeable states of responses: one row per (model, essay, run) that every result can be read from.

A cell holds count, mean, sum of squared deviations, minimum and maximum of the total scores of a
run's responses, and the state from which the essay's ids are read. All buffers have fixed
width, so cells are a hash aggregate that is combined before the shuffle: an essay or model that
holds most responses is a few rows afterwards. Cells of the same run from different inputs may stand
beside each other; whatever reads them merges them (means weighted by counts, squares by the
parallel-variance rule), so a table of cells grows by adding the cells of new inputs.

Written in buckets by (model, essay_id), cells are read by the essay aggregate and the ICC without
another exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterkit.operators import metrics

KEYS = metrics.ESSAY_KEYS


def cells_of(aligned: DataFrame) -> DataFrame:
    """``model, essay_id, run, n, mean, m2, low, high`` and id states of aligned responses; runs without
    a score have ``n = 0``."""
    return aligned.groupBy(*KEYS, "run").agg(
        F.count("total_score").alias("n"),
        F.avg("total_score").alias("mean"),
        (F.var_pop("total_score") * F.count("total_score")).alias("m2"),
        F.min("total_score").alias("low"),
        F.max("total_score").alias("high"),
        *metrics.id_state(aligned.columns),
    )


def scores_of_cells(cells: DataFrame, ids: bool = True) -> DataFrame:
    """A1 from cells: one row per (model, essay), with ids unless ``ids`` is false."""
    essay = Window.partitionBy(*KEYS)
    weight = F.sum("n").over(essay)
    centred = cells.withColumn("_mean", F.when(weight > 0, F.sum(F.col("n") * F.col("mean")).over(essay) / weight))
    squares = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2)
    n = F.sum("n")
    agg = centred.groupBy(*KEYS).agg(
        F.max("_mean").alias("mean_total"),
        F.when(n > 1, F.sqrt(squares / (n - 1))).alias("_sd"),
        F.min("low").alias("min_total"),
        F.max("high").alias("max_total"),
        n.alias("n_runs"),
        *(metrics.merged_id_state(cells.columns) if ids else []),
    )
    essays = metrics.with_ids(metrics.spread(agg))
    return essays.select(*[c for c in metrics.ESSAY_OUTPUT if c in essays.columns])


def runs_of_cells(cells: DataFrame) -> DataFrame:
    """A2 from cells: ``model, essay_id, run, x``, the mean total of a run's responses (NULL: none scored)."""
    n = F.sum("n")
    return cells.groupBy(*KEYS, "run").agg(F.when(n > 0, F.sum(F.col("n") * F.col("mean")) / n).alias("x"))
