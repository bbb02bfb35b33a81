"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

Equal vectors are one node, whatever their number. The graph starts from cells of random
hyperplanes. In each round the members of a node's neighbourhood (its list, and nodes that list
it) are compared with each other and every list keeps its best ``k``; pairs of old members are
not compared again. Rounds end when few lists change.

A list all of whose entries are above the threshold is saturated: there may be more links than
it can hold. Saturated lists are enlarged, to ``ENLARGED`` times the length at most (all links of
a large group would be the square of its size). Threshold edges form clusters, and within a cluster all pairs are compared in
double precision, in blocks of bounded size that return link counts and a spanning forest. A
link between two clusters is in no list only if both its nodes are saturated (a list that is not
holds all links of its node), so the saturated nodes of different clusters are compared too:
each cluster's are dealt out as balls of bounded size, and all pairs of balls are compared whose
centres are not further apart than both radii and the threshold's angle allow, which loses
nothing. So no partner list is capped.

Recall is audited against brute force: a bounded sample of nodes (``AUDIT`` of them, chosen by
a hash) is compared with every node. Recall is the mean over the sampled nodes that have links,
taken by number of links (1, 2 to 3, 4 to 7 ...); the worst of these classes counts, so a large
group cannot hide what small ones miss. Below ``TARGET_RECALL`` the descent goes on with lists
of twice the length; if the last attempt is below it too, all pairs of nodes are compared, in
blocks, at a cost of the square of their number.

Null vectors, those without length, and those with null or non-finite components link with
nothing. Shorter vectors count as padded with zeros. Every row is a vector of its own and is
returned, also where ids are repeated or null; a component's id is the smallest id in it (null if
it has none). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from raterkit.llm.components import components
from raterkit.llm.groups import block_pairs, blocked, grouped, pairs_within, spanning
from raterkit.llm.vectors import matrix
from raterkit.llm.tables import table
from raterkit.session import cut_lineage

THRESHOLD = 0.9
NEIGHBOURS = 10
TREES = 8
CELL = 64
MAX_ROUNDS = 6
SETTLED = 0.01  # share of list entries that change in the last round
AUDIT = 1024
TARGET_RECALL = 0.995
ATTEMPTS = 3
ENLARGED = 4  # times the usual length, at most, of a saturated list
WHOLE_BLOCK = 2048
MARGIN = 0.01  # the rounds work on half-precision vectors


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0.0), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _halves(column) -> np.ndarray:
    """Unit vectors from their half-precision bytes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float16).reshape(len(rows), -1).astype(np.float32)


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``vec_id, h, h2`` of every row (null hashes: takes no part), the nodes
    ``node`` (a number), ``low`` (smallest id), ``copies, embedding, unit``, and the dimension."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    able = F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    keyed = cut_lineage(
        vectors.select(
            "vec_id", F.when(able, F.xxhash64("embedding")).alias("h"), F.when(able, F.xxhash64(F.lit(1), "embedding")).alias("h2"),
            F.when(able, F.col("embedding")).alias("embedding"),
        ),
        "vectors",
    )
    grouped_ = keyed.where("h is not null").groupBy("h", "h2").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")
    )
    grouped_ = grouped_.withColumn("node", F.monotonically_increasing_id())
    dims = keyed.agg(F.max(F.size("embedding"))).head()[0] or 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = _units(matrix(b.column("embedding"), dims)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([u.tobytes() for u in units], pa.binary())], names=[*b.schema.names, "unit"])

    kind = keyed.schema["embedding"].dataType.simpleString()
    nodes = cut_lineage(grouped_.mapInArrow(task, f"h long, h2 long, low long, copies long, embedding {kind}, node long, unit binary"), "nodes")
    return keyed.select("vec_id", "h", "h2"), nodes, dims


EDGE = "src long, dst long, sim float, fresh boolean"


def _edges(src, dst, sim, fresh) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim, pa.float32()), pa.array(fresh, pa.bool_())],
        names=["src", "dst", "sim", "fresh"],
    )


def _best(src, dst, sim, fresh, k) -> pa.RecordBatch:
    """The best ``k`` (a number, or one per row) distinct neighbours of each source; an entry that was
    there stays old."""
    most = np.broadcast_to(np.asarray(k), src.shape)
    order = np.lexsort((fresh, dst, src))
    src, dst, sim, fresh, most = src[order], dst[order], sim[order], fresh[order], most[order]
    first = np.ones(len(src), dtype=bool)
    first[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    src, dst, sim, fresh, most = src[first], dst[first], sim[first], fresh[first], most[first]
    order = np.lexsort((dst, -sim, src))
    src, dst, sim, fresh, most = src[order], dst[order], sim[order], fresh[order], most[order]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    keep = rank < most
    return _edges(src[keep], dst[keep], sim[keep], fresh[keep])


def _lists(edges: DataFrame, k: int, enlarged: DataFrame | None = None, larger: int = 0) -> DataFrame:
    """The best ``k`` entries per source of an edge table; ``larger`` for the ``enlarged(node)`` sources."""
    most = F.lit(k)
    if enlarged is not None:
        edges = edges.join(enlarged.select(F.col("node").alias("src"), F.lit(larger).alias("own")), "src", "left")
        most = F.coalesce("own", most)

    def work(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        return _best(*(t.column(c).to_numpy() for c in ("src", "dst", "sim", "fresh", "most")))

    dealt = edges.select("src", "dst", "sim", "fresh", most.alias("most")).repartition("src").sortWithinPartitions("src")
    return cut_lineage(dealt.mapInArrow(lambda batches: grouped(batches, ["src"], work), EDGE), "neighbours")


def _seed(nodes: DataFrame, n: int, dims: int, k: int, round_: int) -> DataFrame:
    """Edges between nodes that share a cell of random hyperplanes."""
    bits = max(0, min(30, math.ceil(math.log2(max(1.0, n / CELL)))))
    planes = np.random.default_rng(100 + round_).standard_normal((TREES, bits, dims))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _halves(b.column("unit")) if b.num_rows else np.zeros((0, dims))
            for tree in range(TREES):
                code = ((x @ planes[tree].T > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64) + (tree << 32)
                yield pa.RecordBatch.from_arrays([pa.array(code), b.column("node"), b.column("unit")], names=["cell", "node", "unit"])

    placed = nodes.select("node", "unit").mapInArrow(cells, "cell long, node long, unit binary")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    part = F.pmod(F.xxhash64("node", "cell"), F.ceil(F.col("size") / (2 * CELL))).cast("int")
    dealt = placed.join(sizes, "cell").select("cell", part.alias("part"), "node", "unit")
    dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part")

    def work(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        x, node, out = _halves(t.column("unit")), t.column("node").to_numpy(), []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            m = min(k, hi - lo - 1)
            if m < 1:
                continue
            s = x[lo:hi] @ x[lo:hi].T
            np.fill_diagonal(s, -2.0)
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            out.append((np.repeat(node[lo:hi], m), node[lo + top.reshape(-1)], np.take_along_axis(s, top, 1).reshape(-1)))
        if not out:
            return None
        src, dst, sim = (np.concatenate(c) for c in zip(*out))
        return _edges(src, dst, sim, np.ones(len(src), dtype=bool))

    return dealt.mapInArrow(lambda batches: grouped(batches, ["cell", "part"], work), EDGE)


def _round(nodes: DataFrame, lists: DataFrame, k: int, round_: int = 0) -> DataFrame:
    """Edges found by comparing the members of each neighbourhood; of over ``k`` that list a node, other ones each round."""
    forward = lists.select(F.col("src").alias("center"), F.col("dst").alias("member"), "fresh")
    order = Window.partitionBy("center").orderBy(F.desc("fresh"), F.xxhash64("center", "member", F.lit(round_)))
    backward = (
        lists.select(F.col("dst").alias("center"), F.col("src").alias("member"), "fresh")
        .withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    )
    members = forward.unionByName(backward).groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
    lowest = lists.groupBy("src").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("held"))
    floors = nodes.select("node", "unit").join(lowest, F.col("node") == F.col("src"), "left").select(
        F.col("node").alias("member"), "unit", F.when(F.col("held") >= k, F.col("low")).otherwise(F.lit(-2.0)).cast("float").alias("low")
    )
    dealt = members.join(floors, "member").repartition("center").sortWithinPartitions("center")

    def work(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        x = _halves(t.column("unit"))
        member, low, fresh = (t.column(c).to_numpy() for c in ("member", "low", "fresh"))
        out = []
        for i, j in pairs_within(bounds, None):
            new = fresh[i] | fresh[j]
            i, j = i[new], j[new]
            for s in range(0, len(i), 20_000):
                a, b = i[s : s + 20_000], j[s : s + 20_000]
                sim = np.einsum("nd,nd->n", x[a], x[b])
                for u, v in ((a, b), (b, a)):
                    better = sim > low[u]
                    out.append((member[u[better]], member[v[better]], sim[better]))
        if not out:
            return None
        src, dst, sim = (np.concatenate(c) for c in zip(*out))
        return _best(src, dst, sim, np.ones(len(src), dtype=bool), k)

    return dealt.mapInArrow(lambda batches: grouped(batches, ["center"], work), EDGE)


def descend(nodes: DataFrame, lists: DataFrame | None, n: int, dims: int, k: int, attempt: int = 0) -> DataFrame:
    """Refine the neighbour lists (seeded, and joined with ``lists`` if there are any) until they settle."""
    seeds = _seed(nodes, n, dims, k, attempt)
    lists = _lists(seeds if lists is None else seeds.unionByName(lists.withColumn("fresh", F.lit(True))), k)
    for round_ in range(MAX_ROUNDS):
        found = _round(nodes, lists, k, attempt * MAX_ROUNDS + round_)
        lists = _lists(lists.withColumn("fresh", F.lit(False)).unionByName(found), k)
        changed = lists.agg(F.count(F.when(F.col("fresh"), 1))).head()[0]
        if changed <= SETTLED * n * k:
            break
    return lists


def _saturated(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """``node`` of lists of ``k`` entries or more, all of them above the threshold."""
    held = lists.groupBy("src").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("held"))
    return held.where((F.col("held") >= k) & (F.col("low") >= threshold - MARGIN)).select(F.col("src").alias("node"))


def enlarge(nodes: DataFrame, lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """Lists that are saturated grow to twice their length, up to ``ENLARGED`` times ``k``: their entries
    are compared with each other once more, and they keep the best of what comes of it."""
    size = k
    while size < ENLARGED * k:
        full = cut_lineage(_saturated(lists, size, threshold), "full")
        if full.isEmpty():
            break
        size *= 2
        again = lists.drop("fresh").join(full.withColumn("fresh", F.lit(True)), F.col("src") == F.col("node"), "left")
        again = again.select("src", "dst", "sim", F.coalesce("fresh", F.lit(False)).alias("fresh"))
        found = _round(nodes, again, size)
        # lists enlarged before keep their length
        longer = full.unionByName(lists.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select(F.col("src").alias("node"))).distinct()
        lists = _lists(lists.unionByName(found), k, longer, size)
    return lists


LINKS = "node long, links long, label long"


def _linked(x: np.ndarray, node: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple | None:
    """Nodes, link counts and labels of a spanning forest of the links of ``left`` to ``right`` rows (``left`` itself: within)."""
    norm = np.sqrt((x * x).sum(axis=1))
    link = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None, :]) >= threshold
    if left is right:
        np.fill_diagonal(link, False)
    i, j = np.nonzero(link)
    if not len(i):
        return None
    i, j = left[i], right[j]
    count = np.zeros(len(x), dtype=np.int64)
    np.add.at(count, i, copies[j])
    if left is not right:
        np.add.at(count, j, copies[i])
    used = np.flatnonzero(count)
    return node[used], count[used], node[spanning(len(x), i, j)[used]]


def _links(dealt: DataFrame, keys: list[str], side: str, dims: int, threshold: float) -> DataFrame:
    """Links of rows that are dealt out by ``keys``: between both values of ``side``, or within its only one."""

    def work(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        x = matrix(t.column("embedding"), dims)
        node, copies, sides = (t.column(c).to_numpy() for c in ("node", "copies", side))
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            first = sides[lo:hi] == sides[lo]
            left = np.flatnonzero(first)
            two = t.column(keys[-1])[lo].as_py() != t.column(keys[-2])[lo].as_py()
            right = np.flatnonzero(~first) if two else left
            found = _linked(x[lo:hi], node[lo:hi], copies[lo:hi], left, right, threshold)
            if found:
                out.append(found)
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["node", "links", "label"])

    return cut_lineage(dealt.mapInArrow(lambda batches: grouped(batches, keys, work), LINKS), "links")


BALL = "node long, component long, centre binary, radius double"


def _balls(placed: DataFrame, dims: int) -> DataFrame:
    """Centre and radius (an angle) of the vectors of each ball; ``node`` is the ball."""

    def work(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        x = _units(matrix(t.column("embedding"), dims))
        centre = np.add.reduceat(x, bounds[:-1], axis=0)
        weak = np.sqrt((centre * centre).sum(axis=1)) < 1e-6  # opposite vectors: any of them is a centre
        centre[weak] = x[bounds[:-1]][weak]
        centre = _units(centre)
        angle = np.arccos(np.clip(np.einsum("nd,nd->n", x, np.repeat(centre, np.diff(bounds), axis=0)), -1.0, 1.0))
        firsts = pa.array(bounds[:-1])
        return pa.RecordBatch.from_arrays(
            [t.column("ball").combine_chunks().take(firsts), t.column("component").combine_chunks().take(firsts),
             pa.array([c.tobytes() for c in centre], pa.binary()), pa.array(np.maximum.reduceat(angle, bounds[:-1]))],
            names=["node", "component", "centre", "radius"],
        )

    dealt = placed.select("ball", "component", "embedding").repartition("ball").sortWithinPartitions("ball")
    return cut_lineage(dealt.mapInArrow(lambda batches: grouped(batches, ["ball"], work), BALL), "balls")


def _near_balls(balls: DataFrame, n: int, threshold: float) -> DataFrame:
    """``a, b``: pairs of balls of different clusters that may hold a link."""
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def work(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        centre = np.frombuffer(b"".join(t.column("centre").to_pylist())).reshape(t.num_rows, -1)
        node, component, radius, block, bi, bj = (t.column(c).to_numpy() for c in ("node", "component", "radius", "block", "bi", "bj"))
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            rows = np.arange(lo, hi)
            left, right = rows[block[rows] == bi[lo]], rows[block[rows] == bj[lo]]
            apart = np.arccos(np.clip(centre[left] @ centre[right].T, -1.0, 1.0)) - radius[left][:, None] - radius[right][None, :]
            near = (apart <= reach) & (component[left][:, None] != component[right][None, :])
            i, j = np.nonzero(np.triu(near) if bi[lo] == bj[lo] else near)
            out.append((node[left[i]], node[right[j]]))
        a, b = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if len(a) else None

    dealt = block_pairs(balls.withColumn("size", F.lit(n)), [], "size")
    return cut_lineage(dealt.mapInArrow(lambda batches: grouped(batches, ["bi", "bj"], work), "a long, b long"), "near-balls")


def saturated_links(nodes: DataFrame, lists: DataFrame, member: DataFrame, dims: int, k: int, threshold: float) -> DataFrame | None:
    """Links between saturated nodes of different clusters ``member(node, component)``, as ``verified_links``."""
    full = _saturated(lists, k, threshold)
    own = cut_lineage(member.join(full, "node"), "saturated")
    sizes = own.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    if sizes.limit(2).count() < 2:
        return None
    cell = blocked(own.join(sizes, "component"), "size")
    ball = F.min("node").over(Window.partitionBy("component", "block"))
    placed = cut_lineage(cell.select("component", "node", ball.alias("ball")).join(nodes.select("node", "copies", "embedding"), "node"), "placed")
    balls = _balls(placed, dims)
    pairs = _near_balls(balls, balls.count(), threshold)
    rows = placed.select("ball", "node", "copies", "embedding")
    sides = [pairs.join(rows.withColumnRenamed("ball", c), c).select("a", "b", F.col(c).alias("ball"), "node", "copies", "embedding") for c in ("a", "b")]
    dealt = sides[0].unionByName(sides[1]).repartition("a", "b").sortWithinPartitions("a", "b")
    return _links(dealt, ["a", "b"], "ball", dims, threshold)


def verified_links(nodes: DataFrame, lists: DataFrame, dims: int, threshold: float, k: int) -> DataFrame:
    """``node, links, label``: link counts (over vectors) and spanning links of the clusters of threshold edges,
    and of the saturated nodes of different clusters."""
    near = lists.where(F.col("sim") >= threshold - MARGIN).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    member = cut_lineage(components(near), "clusters")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = member.join(sizes, "component").join(nodes.select("node", "copies", "embedding"), "node")
    within = _links(block_pairs(rows, ["component"], "size"), ["component", "bi", "bj"], "block", dims, threshold)
    across = saturated_links(nodes, lists, member, dims, k, threshold)
    return within if across is None else within.unionByName(across)


def all_links(nodes: DataFrame, n: int, dims: int, threshold: float) -> DataFrame:
    """As ``verified_links``, from all pairs of nodes."""
    rows = nodes.select("node", "copies", "embedding").withColumn("size", F.lit(n))
    return _links(block_pairs(rows, [], "size", WHOLE_BLOCK), ["bi", "bj"], "block", dims, threshold)


def audit(nodes: DataFrame, links: DataFrame, dims: int, threshold: float, sample: int = AUDIT) -> float:
    """Mean share of its links that were found of a node of a bounded sample, against brute force:
    the lowest of the means by number of links (1, 2 to 3, 4 to 7 ...)."""
    chosen = nodes.select("node", "embedding").orderBy(F.xxhash64("node", F.lit(9)), "node").limit(sample).toArrow()
    ids, x = chosen.column("node").to_numpy(), matrix(chosen.column("embedding"), dims)
    norm = np.sqrt((x * x).sum(axis=1))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for b in batches:
            y, own, copies = matrix(b.column("embedding"), dims), b.column("node").to_numpy(), b.column("copies").to_numpy()
            link = (y @ x.T) / (np.sqrt((y * y).sum(axis=1))[:, None] * norm[None, :]) >= threshold
            total += ((link & (own[:, None] != ids[None, :])) * copies[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "n"])

    true = nodes.select("node", "copies", "embedding").mapInArrow(task, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    found = links.groupBy("node").agg(F.sum("links").alias("links"))
    share = F.least("n", F.coalesce("links", F.lit(0))) / F.col("n")
    by_size = true.where("n > 0").join(found, "node", "left").groupBy(F.floor(F.log2("n"))).agg(F.avg(share).alias("recall"))
    worst = by_size.agg(F.min("recall")).head()[0]
    return 1.0 if worst is None else worst


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector of ``vectors(vec_id, embedding)``."""
    keyed, nodes, dims = nodes_of(vectors.select("vec_id", "embedding"))
    n = nodes.count()
    lists: DataFrame | None = None
    for attempt in range(ATTEMPTS):
        lists = enlarge(nodes, descend(nodes, lists, n, dims, k, attempt), k, threshold)
        links = verified_links(nodes, lists, dims, threshold, k)
        if audit(nodes, links, dims, threshold) >= TARGET_RECALL:
            break
        k *= 2
    else:
        links = all_links(nodes, n, dims, threshold)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("node").alias("a"), F.col("label").alias("b")))
    named = groups.join(nodes.select("node", "low"), "node")
    lowest = named.groupBy("component").agg(F.min("low").alias("lowest"))
    groups = cut_lineage(groups.join(lowest, "component").select("node", "lowest"), "components")
    info = (
        nodes.select("h", "h2", "node", "low", "copies").join(counts, "node", "left").join(groups, "node", "left")
        .where("copies > 1 or links is not null")
        .select("h", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lowest", "low").alias("component_id"))
    )
    joined = keyed.join(cut_lineage(info, "linked"), ["h", "h2"], "left")  # equal vectors are a split of the join
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links of cosine 0.9 or more and its component."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
