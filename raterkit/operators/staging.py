"""Keep rows on a condition computed from staged (already projected) columns.

``df.where(cond)`` after an expensive projection lets the optimizer push the
predicate below the projection, substituting each alias by its expression: the
text features would then be computed twice (once in the filter, once in the
projection) and, below a round-robin exchange, on the scan's single task.
``keep_where`` expresses the same row selection as a generator (``explode`` of
a one-element array or of nothing), which Catalyst leaves above the staged
projection, so every feature is still computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, cond: Column) -> DataFrame:
    """Rows of ``df`` where ``cond`` is true (NULL counts as false)."""
    marker = F.explode(F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    return df.select("*", marker.alias("_kept")).drop("_kept")
