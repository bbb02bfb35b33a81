"""Positions and running sums over orders that may put most rows into one group.

A window over a group would make it one task. Here rows are dealt out by ranges of the order,
each range is summed on its own, and the ranges' totals (one row for each group and range) are
summed before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterkit.session import cut_lineage


def before_in_order(rows: DataFrame, keys: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` (long) over the rows of the same ``keys`` that
    stand before, by ``order`` ascending, nulls first.

    Rows must differ in (keys, order); sum up repeats before. Null keys are a group.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged, "ranges")  # what a range holds is fixed from here on
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn(name, F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return _offset(inside, ranged, keys, "_range", [(amount, name)])


def running_sums(rows: DataFrame, keys: list[str], position: str, amounts: dict[str, str], block: int) -> DataFrame:
    """``rows`` with, per entry of ``amounts`` (name: column), the sum up to and including the row by
    the integer ``position``, which is unique within ``keys``; ``block`` positions are one window."""
    blocked = rows.withColumn("_block", F.floor(F.col(position) / block))
    within = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    inside = blocked.withColumns({name: F.sum(amount).over(within) for name, amount in amounts.items()})
    return _offset(inside, blocked, keys, "_block", [(amount, name) for name, amount in amounts.items()])


def _offset(inside: DataFrame, rows: DataFrame, keys: list[str], part: str, sums: list[tuple[str, str]]) -> DataFrame:
    """Add to each running sum what the earlier parts of its group hold."""
    totals = rows.groupBy(*keys, part).agg(*[F.sum(amount).alias(f"_of_{name}") for amount, name in sums])
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col(part).alias("_key_part"),
        *[F.coalesce(F.sum(f"_of_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for _, name in sums],
    )
    same: Column = F.col(part) == F.col("_key_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = inside.join(offsets, same)
    joined = joined.withColumns({name: F.col(name) + F.col(f"_before_{name}") for _, name in sums})
    return joined.drop(part, "_key_part", *[f"_key_{k}" for k in keys], *[f"_before_{name}" for _, name in sums])
