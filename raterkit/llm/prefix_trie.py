"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

Every conversation is rebuilt first (see ``rebuilt``). A prefix of d turns is known by d and two
64-bit sums (exclusive or) of hashes of each turn with its place, so the keys of all prefixes of
a conversation are one running sum, and a node's parent key is its own without the last turn.
Nodes are groups of equal keys. The tour has an arc into each node and one out of it;
``list_rank`` gives their positions, and a subtree's leaves and savings are differences of
running sums over these positions. Depth is no matter to it: a conversation of a million turns
is a path like any other.

Nothing is gathered per conversation, node or parent: ranks, running sums and sibling order go by
ranges or buckets, so a conversation, first turn or group of copies may hold any share of the rows.
The one exception is inherent: SHA-256 over the ids that end at a node is sequential, so each node's
ids are joined in chunks in parallel and the chunks streamed through the hash, without being held.

Null role or text is empty. Rows without conv_id belong to no conversation and are left out. Turns
with equal numbers stand in the order of the SHA-256 of role and text; repeated rows are turns
of their own. Other columns are ignored. No conversations: no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raterkit.llm.list_rank import ranked
from raterkit.llm.order import before_in_order, running_sums
from raterkit.llm.tables import table
from raterkit.session import cut_lineage

GROUP = 5
MOST_SHARED = 9
CHUNK = 1024  # turns of a conversation, and children of a node, in one window
SUM_BLOCK = 1 << 16


def digest() -> Column:
    """SHA-256 of a turn's role and text; the length keeps them apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 0), ``digest, bytes`` of every turn."""
    plain = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = plain.select("conv_id", "turn", digest().alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    distinct = turns.groupBy("conv_id", "turn", "digest").agg(F.max("bytes").alias("bytes"), F.count("*").alias("copies"))
    placed = before_in_order(distinct, ["conv_id"], ["turn", "digest"], "copies", "first")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return placed.select("conv_id", "digest", "bytes", "first", each.alias("copy")).select(
        "conv_id", (F.col("first") + F.col("copy")).alias("pos"), "digest", "bytes"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths (``conv_id, length``) of the rebuilt conversations.

    Conversation c has the first h turns of conversation c - c % 5, h = crc32(c) % 9, and then
    its own turns after its first h.
    """
    own = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("turns"))
    convs = own.select(
        "conv_id",
        "turns",
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("h"),
    )
    bases = own.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    convs = convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("shared"), "turns"
    )
    convs = cut_lineage(convs.withColumn("length", F.col("shared") + F.greatest(F.lit(0), F.col("turns") - F.col("h"))), "rebuilt")
    heads = turns.where(F.col("pos") < MOST_SHARED).withColumnRenamed("conv_id", "base")
    shared = convs.select("conv_id", "base", "shared").join(heads, "base").where("pos < shared")
    rest = turns.join(convs.select("conv_id", "h", "shared"), "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("shared"))
    columns = ["conv_id", "pos", "digest", "bytes"]
    return shared.select(*columns).unionByName(rest.select(*columns)), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row per conversation and prefix, the empty one included: ``conv_id, depth, a, b`` (key),
    ``up_a, up_b`` (the parent's key), ``bytes`` (of the last text), ``ends``."""
    keyed = turns.withColumns({"own_a": F.xxhash64(F.lit(1), "digest", "pos"), "own_b": F.xxhash64(F.lit(2), "pos", "digest"), "chunk": F.floor(F.col("pos") / CHUNK)})
    keyed = cut_lineage(keyed, "turns")
    within = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = keyed.withColumns({"a": F.expr("bit_xor(own_a)").over(within), "b": F.expr("bit_xor(own_b)").over(within)})
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = keyed.groupBy("conv_id", "chunk").agg(F.expr("bit_xor(own_a)").alias("all_a"), F.expr("bit_xor(own_b)").alias("all_b"))
    chunks = chunks.select("conv_id", "chunk", *[F.coalesce(F.expr(f"bit_xor(all_{k})").over(earlier), F.lit(0)).alias(f"before_{k}") for k in "ab"])
    whole = inside.join(chunks, ["conv_id", "chunk"]).withColumns({k: F.col(k).bitwiseXOR(F.col(f"before_{k}")) for k in "ab"})
    zero = F.lit(0).cast("long")
    rows = whole.join(lengths, "conv_id").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "a", "b",
        *[F.col(k).bitwiseXOR(F.col(f"own_{k}")).alias(f"up_{k}") for k in "ab"],
        "bytes", (F.col("pos") + 1 == F.col("length")).alias("ends"),
    )
    roots = lengths.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("a", "b", "up_a", "up_b", "bytes")], (F.col("length") == 0).alias("ends"))
    return cut_lineage(rows.unionByName(roots), "prefixes")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, which follow each other."""
    key, state, out = None, None, []
    for batch in batches:
        for *node, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids")], strict=True):
            if node != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b",")
                state.update(ids.encode())
        if len(out) > 10_000:
            yield _digests(out)
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield _digests(out)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    depth, a, b, found = zip(*rows, strict=True)
    return pa.record_batch({"depth": pa.array(depth, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "ends_sha256": pa.array(found)})


def end_digests(members: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256`` of the nodes at which conversations end."""
    ends = members.where("ends").select("depth", "a", "b", "conv_id", F.shiftright("conv_id", 12).alias("range"))
    chunks = ends.groupBy("depth", "a", "b", "range").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))
    runs = chunks.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "range")
    return runs.mapInArrow(_hashed, "depth long, a long, b long, ends_sha256 string")


def trie_nodes(members: DataFrame) -> DataFrame:
    """``node`` (a number), ``conv_id, depth, a, b, parent, parent_conv_id, n_convs, saved``."""
    groups = members.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.max("bytes").alias("bytes")
    )
    nodes = cut_lineage(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")
    )
    joined = nodes.join(parents, ["depth", "up_a", "up_b"], "left")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    return cut_lineage(joined.select("node", "conv_id", "depth", "a", "b", "parent", "parent_conv_id", "n_convs", saved.alias("saved")), "trie")


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``arc, prev, next`` of the Euler tour (arc 2 * node goes in, 2 * node + 1 out), and
    ``node, n_children``. Children stand in hashed buckets of about ``CHUNK``, by number within."""
    kids = nodes.where("parent is not null").select("node", "parent")
    counts = kids.groupBy("parent").agg(F.count("*").alias("n_children"))
    kids = kids.join(counts, "parent").withColumn("bucket", F.pmod(F.xxhash64("node"), F.floor(F.col("n_children") / CHUNK) + 1))
    kids = cut_lineage(kids, "children")
    by_number = Window.partitionBy("parent", "bucket").orderBy("node")
    near = kids.withColumns({"left": F.lag("node").over(by_number), "right": F.lead("node").over(by_number)})
    by_bucket = Window.partitionBy("parent").orderBy("bucket")
    buckets = kids.groupBy("parent", "bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    buckets = buckets.withColumns({"bucket_left": F.lag("high").over(by_bucket), "bucket_right": F.lead("low").over(by_bucket)})
    near = near.join(buckets.select("parent", "bucket", "bucket_left", "bucket_right"), ["parent", "bucket"])
    near = near.select("node", "parent", F.coalesce("left", "bucket_left").alias("left"), F.coalesce("right", "bucket_right").alias("right"))
    outer = buckets.groupBy("parent").agg(
        F.max(F.when(F.col("bucket_left").isNull(), F.col("low"))).alias("first"), F.max(F.when(F.col("bucket_right").isNull(), F.col("high"))).alias("last")
    )
    outer = outer.join(counts, "parent").withColumnRenamed("parent", "node")
    links = nodes.select("node").join(near, "node", "left").join(outer, "node", "left")
    links = cut_lineage(links.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "links")
    into, out = F.col("node") * 2, F.col("node") * 2 + 1
    enter = links.select(
        into.alias("arc"), F.coalesce(F.col("left") * 2 + 1, F.col("parent") * 2).alias("prev"), F.coalesce(F.col("first") * 2, out).alias("next")
    )
    leave = links.select(out.alias("arc"), F.coalesce(F.col("last") * 2 + 1, into).alias("prev"), F.coalesce(F.col("right") * 2, F.col("parent") * 2 + 1).alias("next"))
    return enter.unionByName(leave), links.select("node", "n_children")


def subtree_sums(nodes: DataFrame, children: DataFrame, ranks: DataFrame) -> DataFrame:
    """``node, n_leaves, saved_tokens`` from running sums over the arcs in tour order."""
    weights = nodes.join(children, "node").select(
        (F.col("node") * 2).alias("arc"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), "saved"
    )
    at = ranks.select("arc", (-F.col("rank")).alias("position")).join(weights, "arc", "left").na.fill(0, ["leaf", "saved"])
    sums = running_sums(at, [], "position", {"leaves": "leaf", "savings": "saved"}, SUM_BLOCK)
    out = F.col("arc") % 2 == 1
    return sums.groupBy(F.shiftright("arc", 1).alias("node")).agg(
        F.sum(F.when(out, F.col("leaves")).otherwise(F.col("leaf") - F.col("leaves"))).alias("n_leaves"),
        F.sum(F.when(out, F.col("savings")).otherwise(F.col("saved") - F.col("savings"))).alias("saved_tokens"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    members = prefixes(*rebuilt(cut_lineage(ordered_turns(conversations), "ordered")))
    nodes = trie_nodes(members)
    arcs, children = tour(nodes)
    sums = subtree_sums(nodes, children, ranked(arcs))
    whole = nodes.join(children, "node").join(sums, "node").join(end_digests(members), ["depth", "a", "b"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all ``conversations``."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
