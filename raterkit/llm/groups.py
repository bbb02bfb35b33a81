"""Groups of bounded size as runs of rows: dealing them out, streaming them, linking within them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def blocked(rows: DataFrame, size: str, block: int | None = None) -> DataFrame:
    """``rows`` with the number of blocks of their group and their own: ``blocks, block``."""
    blocks = F.ceil(F.col(size) / (block or BLOCK)).cast("int")
    return rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))


def block_pairs(rows: DataFrame, keys: list[str], size: str, block: int | None = None) -> DataFrame:
    """Deal groups out as pairs of blocks: columns ``block, bi, bj``; sorted by group."""
    own = blocked(rows, size, block)
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "blocks", size)
    return dealt.repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj")



def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None]):
    """Call ``work(rows, bounds)`` with whole groups of rows that are consecutive by ``keys``."""

    def bounds_of(t: pa.Table) -> np.ndarray:
        columns = [t.column(k).to_numpy() for k in keys]
        change = np.zeros(max(0, t.num_rows - 1), dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        return np.concatenate(([0], np.flatnonzero(change) + 1, [t.num_rows]))

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < 2000:
            continue
        b = bounds_of(held)
        if len(b) > 2:
            out = work(held.slice(0, int(b[-2])).combine_chunks(), b[:-1])
            held = held.slice(int(b[-2])).combine_chunks()
            if out is not None:
                yield out
    if held is not None and held.num_rows:
        out = work(held.combine_chunks(), bounds_of(held))
        if out is not None:
            yield out


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of ``n`` indices by the links ``i - j``."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def pairs_within(bounds: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups, one lag at a time; with ``side``, pairs of different sides only."""
    size = np.diff(bounds)
    group_end = np.repeat(bounds[1:], size)
    at = np.arange(bounds[-1])
    lag = 1
    while True:
        at = at[at + lag < group_end[at]]
        if not len(at):
            return
        if side is None:
            yield at, at + lag
        else:
            keep = side[at] != side[at + lag]
            yield at[keep], at[keep] + lag
        lag += 1
