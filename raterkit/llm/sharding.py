"""Shards balanced in bytes, tokens and rows at once, by vector bin packing of groups of equal texts.

A group's copies stay in one shard. Groups are placed largest first, each where the dot product
of its vector (bytes, tokens, rows, as shares of all) with what is left of a shard's capacity
is highest, among the shards that it still fits in; if it fits in none, where the least is overfull.

The driver places a bounded number of items. Groups of more than ``1 / (shards * FINE)`` of all
bytes, tokens or rows are items of their own: there are at most ``3 * shards * FINE`` of them. All
smaller groups are dealt by hash into ``shards * FINE`` bundles, each an item. A group of more than
``1 / PARTS`` of a shard in any of the three cannot stay whole without unbalancing it; it is cut into parts of
that size by row. What comes back to the rows is a table with one row per item.

Slots are the rows' numbers in their shard, from counts over (shard, block of rows), so no shard is
one task. Null texts are empty and so equal to empty ones; null and repeated ids are rows like
others. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raterkit.llm.tables import table
from raterkit.session import cut_lineage

SHARDS = 16
FINE = 1024
PARTS = 4
ROWS_A_BLOCK = 20_000
MEASURES = ["size", "tokens", "rows"]


def word_count(text: Column) -> Column:
    """Words between white space: what stands for tokens unless the caller gives another count."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item, a row of ``vectors`` (shares of all, one column per measure).

    Largest first, ties by place; where the dot product with the residual capacity is highest,
    among shards with room in every measure, lowest number first.
    """
    left = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-vectors.max(axis=1, initial=0), kind="stable"):
        after = left - vectors[i]
        fits = (after >= -1e-12).all(axis=1)
        if fits.any():
            shard = int(np.argmax(np.where(fits, left @ vectors[i], -np.inf)))
        else:
            shard = int(np.argmax(after.min(axis=1)))
        left[shard], out[i] = after[shard], shard
    return out


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))


def _share(totals: dict[str, int]) -> Column:
    """The largest of a group's shares of all bytes, tokens and rows."""
    return F.greatest(*[F.col(m) / F.lit(totals[m]) for m in MEASURES])


def sharded(docs: DataFrame, shards: int = SHARDS, tokens: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, text) as ``doc_id, size, text_crc32, shard, slot``, a row for each row."""
    spark = docs.sparkSession
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = plain.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        (word_count(F.col("text")) if tokens is None else tokens).alias("tokens"),
        F.xxhash64(F.lit(1), "text").alias("a"),
        F.xxhash64(F.lit(2), "text").alias("b"),
    )
    rows = cut_lineage(rows, "rows")
    totals = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first().asDict()
    totals = {m: max(1, totals[m] or 0) for m in MEASURES}  # 1: no rows, nothing is divided
    groups = _sums(rows, "a", "b").withColumn("share", _share(totals))
    large = cut_lineage(groups.where(F.col("share") > 1.0 / (shards * FINE)), "large")
    parts = large.select("a", "b", F.greatest(F.lit(1), F.ceil(F.col("share") * (shards * PARTS))).cast("int").alias("parts"))
    # large groups are at most 3 * shards * FINE by what makes them large, bundles shards * FINE
    dealt = rows.join(F.broadcast(parts), ["a", "b"], "left").select(
        "row", "doc_id", "size", "text_crc32", "tokens", F.col("parts").isNotNull().alias("own"),
        F.when(F.col("parts").isNotNull(), F.col("a")).otherwise(F.pmod(F.col("a"), F.lit(shards * FINE))).alias("item_a"),
        F.when(F.col("parts").isNotNull(), F.col("b")).otherwise(F.lit(0)).alias("item_b"),
        F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.lit(0)).alias("part"),
    )
    dealt = cut_lineage(dealt, "dealt")
    keys = ["own", "item_a", "item_b", "part"]
    items = _sums(dealt, *keys).toPandas().sort_values(keys, ignore_index=True)
    vectors = items[MEASURES].to_numpy(float) / np.array([totals[m] for m in MEASURES])
    plan = pd.DataFrame({k: items[k] for k in keys} | {"shard": place(vectors, shards)})
    placed = spark.createDataFrame(plan, "own boolean, item_a long, item_b long, part int, shard int")
    whole = dealt.join(F.broadcast(placed), keys).select("row", "doc_id", "size", "text_crc32", "shard")
    blocks = -(-totals["rows"] // (shards * ROWS_A_BLOCK))
    whole = cut_lineage(whole.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), "placed")
    within = Window.partitionBy("shard", "block").orderBy("row")
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    numbered = whole.withColumn("number", F.row_number().over(within) - 1).join(starts, ["shard", "block"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("number")).cast("long").alias("slot"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards with near-equal bytes (and tokens and rows)."""
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
