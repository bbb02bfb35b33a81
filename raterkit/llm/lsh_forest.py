"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is its set of shingles of ``WORDS`` lower-case words (ASCII white space separates;
a shorter text is one shingle). Documents with equal sets are one class, whatever their number;
only classes are compared. Two documents are linked if their sets have a Jaccard similarity of
``THRESHOLD`` or more.

The forest has ``TREES`` prefix tries over minhash labels of ``DEPTH`` values. Classes that share
a prefix in some tree are candidates: a bucket of the current length, sorted by the rest of the
labels, holds its longer prefixes as runs. A pair of similarity s is found with probability
1 - (1 - s^depth)^TREES. Prefixes begin at the longest at which a pair at the threshold itself is
found with the target's probability, so that no pair's chance depends on what else is in the
corpus. Recall is audited: a bounded sample of classes (``AUDIT``, chosen by a hash) is compared
with every class by the whole sketch, and the share of its similar pairs that share a prefix is
averaged by number of such pairs (1, 2 to 3, 4 to 7 ...); the worst of these counts. While it is
below the target, prefixes are shortened by a value, and only pairs without a longer common prefix are
compared anew. Within a bucket candidates are compared by a byte sketch of all labels, with a
margin that no linked pair falls short of in practice (more than four standard deviations).
Sketch-similar classes form clusters, and all pairs within a cluster are then verified exactly
on their whole shingle sets (64-bit hashes).

A large bucket or cluster is dealt out as pairs of blocks of bounded size, each a group of its
own; a group returns link counts per class and a spanning forest of its links, never the pairs.
No bucket, cluster or partner list is capped.

Texts without a word link with nothing. Rows that repeat an id count as documents of their own
for links, and share their class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterkit.llm import grams
from raterkit.llm.components import components
from raterkit.llm.groups import block_pairs, grouped, pairs_within, spanning
from raterkit.llm.tables import table
from raterkit.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 7
LEAST_DEPTH = 3
TARGET_RECALL = 0.999
SKETCH_THRESHOLD = 0.64
AUDIT = 256
NO_ID = -(2**63)

# --- shingles and signatures ------------------------------------------------------------

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts, and the bounds of each text's."""
    points, starts = grams.code_points([t.lower() for t in texts])
    begin, end = grams.word_spans(points)
    w = grams.span_hashes(points, begin, end)
    at = np.searchsorted(begin, starts)
    n_words = np.diff(at)
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    bounds = np.concatenate(([0], np.cumsum(n)))
    first = np.repeat(at[:-1] - bounds[:-1], n) + np.arange(bounds[-1])  # word at which each shingle begins
    length = np.minimum(np.repeat(n_words, n), words)
    padded = np.concatenate((w, np.zeros(words, np.uint64)))
    h = length.astype(np.uint64)
    for k in range(words):
        h = h + np.where(k < length, padded[first + k], 0).astype(np.uint64) * _FACTORS[k % 5] * np.uint64(2 * (k // 5) + 1)
    return grams.mix64(h), bounds


def set_key(unique: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    one = int(grams.mix64(unique).sum(dtype=np.uint64))
    two = int(grams.mix64(unique ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64))
    return one.to_bytes(8, "big") + two.to_bytes(8, "big")


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhashes(h: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """``texts x n`` minhash values; texts without shingles are not to be asked for."""
    base = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(bounds) - 1), dtype=np.uint32)
    for k, (flip, factor) in enumerate(zip(*_seeds(n))):
        x = base ^ flip
        x *= factor
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[k] = np.minimum.reduceat(x, bounds[:-1])
    return out.T


def _signature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = grams.texts_of(batch.column("text"))
        nodes: list[bytes | None] = []
        labels: list[bytes | None] = []
        sketches: list[bytes | None] = []
        for lo, hi in grams.chunks(texts):
            h, bounds = shingles(texts[lo:hi])
            full = np.flatnonzero(np.diff(bounds))
            values = minhashes(h, np.concatenate((bounds[full], bounds[-1:])), TREES * DEPTH) if len(full) else None
            row = dict(zip(full.tolist(), range(len(full))))
            for i in range(hi - lo):
                if i in row:
                    own = values[row[i]]
                    nodes.append(set_key(np.unique(h[bounds[i] : bounds[i + 1]])))
                    labels.append(own.astype("<u4").tobytes())
                    sketches.append(own.astype(np.uint8).tobytes())
                else:
                    nodes.append(None)
                    labels.append(None)
                    sketches.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("t"), *(pa.array(x, pa.binary()) for x in (nodes, labels, sketches))],
            names=["doc_id", "t", "node", "labels", "sketch"],
        )


# --- candidates -------------------------------------------------------------------------

EDGES = "a binary, b binary"


def _labels(column) -> np.ndarray:
    """``rows x trees x values`` from the labels' bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, TREES, DEPTH)


def _key_task(depth: int):
    """A row per class and tree: the hashed prefix, and the rest of the label (its first value apart)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _labels(batch.column("labels"))
            factors = np.random.default_rng(5).integers(0, 2**63, (TREES, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            keys = grams.mix64((values[:, :, :depth] * factors).sum(axis=2, dtype=np.uint64) + np.arange(TREES, dtype=np.uint64) * _FACTORS[0])
            after = values[:, :, depth] if depth < DEPTH else np.zeros(values.shape[:2], dtype=np.uint32)
            rows = np.repeat(np.arange(batch.num_rows), TREES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(after.reshape(-1).astype(np.int64)), batch.column("node").take(pa.array(rows))],
                names=["key", "after", "node"],
            )

    return task


def _compare_task(again: bool):
    """A spanning forest of the sketch-similar pairs of each bucket; ``again``: of those that do not
    share a longer prefix, the others having been compared before."""

    def work(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
        after, block = t.column("after").to_numpy(), t.column("block").to_numpy()
        same = t.column("bi").to_numpy() == t.column("bj").to_numpy()
        left, right = [], []
        one_block = np.where(same, np.arange(t.num_rows), -1 - block)  # rows of one block: all sides differ
        for a, b in pairs_within(bounds, one_block):
            if again:
                new = after[a] != after[b]
                a, b = a[new], b[new]
            for s in range(0, len(a), 50_000):
                i, j = a[s : s + 50_000], b[s : s + 50_000]
                similar = ((sketch[i] == sketch[j]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                keep = similar >= SKETCH_THRESHOLD
                left.append(i[keep])
                right.append(j[keep])
        i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
        if not len(i):
            return None
        label = spanning(t.num_rows, i, j)
        linked = np.flatnonzero(label != np.arange(t.num_rows))
        node = t.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(linked)), node.take(pa.array(label[linked]))], names=["a", "b"])

    return lambda batches: grouped(batches, ["key", "bi", "bj"], work)


def _candidates(classes: DataFrame, depth: int, again: bool = False) -> DataFrame:
    """Sketch-similar edges of the buckets at a prefix length."""
    keys = classes.select("node", "labels").mapInArrow(_key_task(depth), "key long, after long, node binary")
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("after").alias("low"), F.max("after").alias("high")).where("size > 1")
    if again:
        buckets = buckets.where("low <> high")
    members = keys.join(buckets.select("key", "size"), "key").join(classes.select("node", "sketch"), "node")
    dealt = block_pairs(members, ["key"], "size").sortWithinPartitions("key", "bi", "bj", "after", "node")
    return cut_lineage(dealt.mapInArrow(_compare_task(again), EDGES), "candidates")


def found_chance(similarity: float, depth: int, trees: int = TREES) -> float:
    return 1.0 - (1.0 - similarity**depth) ** trees


def _depth() -> int:
    """The longest prefix that finds a pair at the threshold with the target's probability."""
    able = [d for d in range(LEAST_DEPTH, DEPTH + 1) if found_chance(THRESHOLD, d) >= TARGET_RECALL]
    return max(able, default=LEAST_DEPTH)


def audited_recall(classes: DataFrame, sample: int = AUDIT) -> dict[int, float]:
    """By prefix length, the mean share of the similar pairs of a bounded sample of classes that share
    such a prefix in some tree: the lowest of the means by number of pairs."""
    chosen = classes.select("node", "labels").orderBy(F.xxhash64("node"), "node").limit(sample).toArrow()
    if not chosen.num_rows:
        return {}
    own, nodes = _labels(chosen.column("labels")), chosen.column("node").to_pylist()
    least = ((1 - 1 / 256) * THRESHOLD + 1 / 256) * TREES * DEPTH  # bytes that agree
    sketch, place = own.astype(np.uint8).reshape(len(own), -1), {n: i for i, n in enumerate(nodes)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(own), DEPTH + 1), dtype=np.int64)  # pairs by longest common prefix
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _labels(batch.column("labels"))
            others = values.astype(np.uint8).reshape(len(values), -1)
            at = [place.get(n, -1) for n in batch.column("node").to_pylist()]
            for i in range(len(own)):
                rows = np.flatnonzero(np.count_nonzero(others == sketch[i], axis=1) >= least)
                if len(rows):
                    rows = rows[np.array([at[r] != i for r in rows.tolist()])]
                    shared = np.cumprod(values[rows] == own[i], axis=2).sum(axis=2).max(axis=1, initial=0)
                    found[i] += np.bincount(shared, minlength=DEPTH + 1)
        i, d = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(d), pa.array(found[i, d])], names=["i", "shared", "n"])

    rows = classes.select("node", "labels").mapInArrow(task, "i long, shared long, n long").groupBy("i", "shared").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((len(own), DEPTH + 1))
    pairs[rows["i"].to_numpy(), rows["shared"].to_numpy()] = rows["n"].to_numpy()
    total = pairs.sum(axis=1)
    has = total > 0
    share = np.cumsum(pairs[has, ::-1], axis=1)[:, ::-1] / total[has, None]  # with a common prefix of d or more
    group = np.floor(np.log2(total[has])).astype(int)
    return {d: min((float(share[group == g, d].mean()) for g in np.unique(group)), default=1.0) for d in range(LEAST_DEPTH, DEPTH + 1)}


def clusters(classes: DataFrame, depth: int | None = None, rounds: list[int] | None = None) -> DataFrame:
    """``node, cluster`` of the classes that have a sketch-similar candidate; ``rounds`` collects the
    prefix lengths taken, from ``depth`` (see ``_depth``) on."""
    depth = depth or _depth()
    recall = audited_recall(classes)
    rounds = [] if rounds is None else rounds
    rounds.append(depth)
    found = _candidates(classes, depth)
    while depth > LEAST_DEPTH and recall.get(depth, 1.0) < TARGET_RECALL:
        depth -= 1
        rounds.append(depth)
        found = found.unionByName(_candidates(classes, depth, again=True))
    return components(found).withColumnRenamed("component", "cluster")


# --- verification -----------------------------------------------------------------------


def _shingle_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        texts, wanted = grams.texts_of(batch.column("text")), batch.column("node").to_pylist()
        keep, sets = [], []
        for i, text in enumerate(texts):
            if wanted[i] == last:  # rows with equal id and text follow each other
                continue
            last = wanted[i]
            unique = np.unique(shingles([text])[0])
            if len(unique) and set_key(unique) == wanted[i]:
                keep.append(i)
                sets.append(unique.view(np.int64))
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [rows.column(c) for c in ("cluster", "node", "copies", "size")] + [pa.array(sets, pa.list_(pa.int64()))],
            names=["cluster", "node", "copies", "size", "shingles"],
        )


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, from 0/1 matrices of a slice of the values at a time."""
    sides = [np.concatenate(s) for s in (left, right)]
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    both = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]))
    out = np.zeros((len(left), len(right)))
    parts = []
    for values, row in zip(sides, rows):
        place = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        hit = both[place] == values if len(both) else np.zeros(len(values), bool)
        place, row = place[hit], row[hit]
        order = np.argsort(place, kind="stable")
        parts.append((place[order], row[order]))
    width = 4096
    for lo in range(0, len(both), width):
        matrices = []
        for (place, row), n in zip(parts, (len(left), len(right))):
            a, b = np.searchsorted(place, (lo, lo + width))
            m = np.zeros((n, min(width, len(both) - lo)), dtype=np.float32)
            m[row[a:b], place[a:b] - lo] = 1.0
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    return out


VERIFIED = "node binary, links long, label binary"


def _verify_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        nodes, copies = t.column("node").to_pylist(), t.column("copies").to_numpy()
        block, bi, bj = (t.column(c).to_numpy() for c in ("block", "bi", "bj"))
        column = t.column("shingles").combine_chunks()
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
        out: list[tuple[bytes, int, bytes]] = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            rows = np.arange(lo, hi)
            if bi[lo] == bj[lo]:
                left = right = rows
            else:
                left, right = rows[block[rows] == bi[lo]], rows[block[rows] == bj[lo]]
            if not len(left) or not len(right) or len(rows) < 2:
                continue
            sets = {r: flat[offsets[r] : offsets[r + 1]] for r in rows.tolist()}
            common = overlaps([sets[r] for r in left.tolist()], [sets[r] for r in right.tolist()])
            size = np.diff(offsets)
            union = size[left][:, None] + size[right][None, :] - common
            link = common >= THRESHOLD * union - 1e-9
            if left is right:
                np.fill_diagonal(link, False)
            i, j = np.nonzero(link)
            if not len(i):
                continue
            i, j = left[i], right[j]
            count = np.zeros(hi - lo, dtype=np.int64)
            np.add.at(count, i - lo, copies[j])
            if left is not right:
                np.add.at(count, j - lo, copies[i])
            label = spanning(hi - lo, i - lo, j - lo)
            out += [(nodes[lo + k], int(count[k]), nodes[lo + int(label[k])]) for k in np.flatnonzero(count).tolist()]
        if not out:
            return None
        a, n, b = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(n, pa.int64()), pa.array(b, pa.binary())], names=["node", "links", "label"])

    return grouped(batches, ["cluster", "bi", "bj"], work)


# --- the join ---------------------------------------------------------------------------


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_links, class_id`` for every row of ``docs(doc_id, text)``: the number of other
    documents linked directly, and the smallest id reachable by links (its own, if none)."""
    own = docs.select("doc_id", "text")
    keyed = own.select("doc_id", "text", F.xxhash64("text").alias("t"))
    signed = cut_lineage(keyed.mapInArrow(_signature_task, "doc_id long, t long, node binary, labels binary, sketch binary"), "signatures")
    # labels and sketch depend on the class alone; the text of its smallest id (null last) stands for it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t"))
    classes = cut_lineage(
        signed.where("node is not null").groupBy("node").agg(
            first.alias("of"), F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch")
        ).select("node", F.col("of.doc_id").alias("rep"), F.col("of.t").alias("t"), "copies", "labels", "sketch"),
        "classes",
    )
    member = clusters(classes)
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    wanted = (
        member.join(sizes, "cluster").join(classes.select("node", "rep", "t", "copies"), "node")
        .withColumn("rep", F.coalesce("rep", F.lit(NO_ID)))
    )
    texts = keyed.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), "t", "text").join(wanted, ["rep", "t"])
    sets = texts.mapInArrow(_shingle_task, "cluster binary, node binary, copies long, size long, shingles array<long>")
    sets = sets.dropDuplicates(["node"])
    verified = cut_lineage(block_pairs(sets, ["cluster"], "size").mapInArrow(_verify_task, VERIFIED), "verified")

    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(verified.select(F.col("node").alias("a"), F.col("label").alias("b")))
    reps = classes.select("node", "rep", "copies")
    lowest = groups.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("low"))
    linked = groups.join(lowest, "component").select("node", "low")
    info = (
        reps.join(links, "node", "left").join(linked, "node", "left").where("copies > 1 or links is not null")
        .select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "rep").alias("class_id"))
    )
    info = cut_lineage(info, "classes-linked")  # the copies of one class are then a split of the join
    return signed.select("doc_id", "node").join(info, "node", "left").select(
        "doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id")
    )


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of links, its class, and whether it stands for the class."""
    found = jaccard_groups(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class only the document with the smallest id stays.

    Rows that repeat an id stay or go together; rows without an id stay.
    """
    found = jaccard_groups(docs)
    gone = found.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_near_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_near_id"], "left_anti")
