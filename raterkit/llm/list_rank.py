"""List ranking of a linked list held as a table, by splicing out independent arcs.

In each round an arc leaves the list if its hashed priority is below those of both its
neighbours: about a third of the arcs, never two in a row, so each leaves with its own
successor and weight and its neighbours are joined around it. The work of all rounds is a
geometric sum. What is left at ``LAST`` arcs is ranked by pointer doubling in one small task;
the arcs that left come back in reverse order, each one join from its rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterkit.session import cut_lineage

LAST = 1 << 14
MAX_ROUNDS = 200


def _priority(arc: str, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), F.col(arc))


def _splice(current: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The arcs that stay, linked around those that leave, and those that leave."""
    own = _priority("arc", turn)
    leaves = F.coalesce((own < _priority("next", turn)) & (own < _priority("prev", turn)), F.lit(False))
    leaves &= F.col("next").isNotNull() & F.col("prev").isNotNull()
    gone = current.where(leaves)
    after = gone.select(F.col("arc").alias("_a"), F.col("next").alias("_next"), F.col("weight").alias("_weight"))
    before = gone.select(F.col("arc").alias("_b"), F.col("prev").alias("_prev"))
    stay = current.where(~leaves).join(after, F.col("next") == F.col("_a"), "left")
    stay = stay.withColumns({
        "next": F.coalesce("_next", "next"),
        "weight": F.col("weight") + F.coalesce("_weight", F.lit(0)),
    }).drop("_a", "_next", "_weight")
    stay = stay.join(before, F.col("prev") == F.col("_b"), "left").withColumn("prev", F.coalesce("_prev", "prev"))
    return stay.select("arc", "prev", "next", "weight"), gone.select("arc", "next", "weight")


def _doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of at most ``LAST`` arcs by pointer doubling."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    arc = t["arc"].to_numpy()
    order = np.argsort(arc)
    ends = t["next"].is_null().to_numpy()
    at = np.searchsorted(arc, t["next"].fill_null(arc[0]).to_numpy(), sorter=order)
    n = len(arc)
    following = np.append(np.where(ends, n, order[np.minimum(at, n - 1)]), n)
    rank = np.append(t["weight"].to_numpy(), 0)
    while (following < n).any():
        rank = rank + rank[following]
        following = following[following]
    yield pa.record_batch({"arc": pa.array(arc), "rank": pa.array(rank[:n])})


def ranked(arcs: DataFrame, last: int | None = None) -> DataFrame:
    """``arc, rank`` of ``arcs(arc, prev, next)``: how many arcs stand from this one to the end of
    its list, itself included. No arcs: no rows."""
    last = LAST if last is None else last
    current = cut_lineage(arcs.select("arc", "prev", "next", F.lit(1).cast("long").alias("weight")), "arcs")
    left: list[DataFrame] = []
    while current.count() > last:
        if len(left) == MAX_ROUNDS:
            raise RuntimeError(f"list not contracted after {MAX_ROUNDS} rounds: is it a list?")
        stay, gone = _splice(current, len(left))
        left.append(gone)
        current = cut_lineage(stay, "arcs")
    ranks = current.coalesce(1).mapInArrow(_doubled, "arc long, rank long")
    for gone in reversed(left):
        known = ranks.select(F.col("arc").alias("_n"), "rank")
        back = gone.join(known, F.col("next") == F.col("_n")).select("arc", (F.col("weight") + F.col("rank")).alias("rank"))
        ranks = cut_lineage(ranks.unionByName(back), "ranks")
    return ranks
