"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed words (each followed by a token that says
whether it repeats the word before) and character 3-grams; a softmax layer on the average gives the class probabilities. Vectors and layer are trained together by
numpy stochastic gradient descent on a bounded sample of labelled rows (``TRAIN_ROWS``, chosen
by a hash of the id); what reaches the driver are the sample's bucket counts, at most
``2**BITS`` per row. Since the layer is linear in the average, scoring needs one number per
bucket; that table is broadcast and has a fixed size.

Null and empty texts get the score of the bias alone. Labels that are null, or that contradict
each other for one id, are not learned from; with no labels every score is 0.5 (predicted 1).
Repeated rows are scored alike; a repeated id is learned once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raterkit.llm import grams
from raterkit.llm.tables import id_remainder, table

BITS = 17
DIMENSIONS = 12
EPOCHS = 8
RATE = 1.0
TRAIN_ROWS = 4000
SEED = 17
AGAIN, FRESH = 0x1E35A7, 0x2B9D03  # buckets of the tokens for a repeated and for another word


@dataclass
class Features:
    """Buckets of words (two each) and of 3-grams of a chunk of texts, with per-text boundaries."""

    words: np.ndarray
    word_starts: np.ndarray
    grams: np.ndarray  # one per character; those that would leave their text are not valid
    valid: np.ndarray
    starts: np.ndarray


def features(texts: list[str], bits: int = BITS) -> Features:
    points, starts = grams.code_points(texts)
    begin, end = grams.word_spans(points)
    hashes, first = grams.span_hashes(points, begin, end), np.searchsorted(begin, starts)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[first < len(hashes)]] = False
    words = np.empty(2 * len(hashes), dtype=np.int64)
    words[0::2] = hashes >> np.uint64(64 - bits)
    words[1::2] = np.where(again, *(k % (1 << bits) for k in (AGAIN, FRESH)))
    c = np.concatenate((points, np.zeros(2, np.uint32))).astype(np.uint32)
    three = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    three >>= np.uint32(32 - bits)
    valid = np.ones(len(points), dtype=bool)
    for back in (1, 2, 3):
        at = starts[1:] - back
        valid[at[at >= starts[:-1]]] = False
    return Features(words, 2 * first, three, valid, starts)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each pair of neighbouring bounds."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], dtype=np.float64)
    return out


@dataclass
class QualityModel:
    """``table[bucket]`` and ``bias``: contributions to the log odds of label 1."""

    table: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        out = []
        for lo, hi in grams.chunks(texts):
            f = features(texts[lo:hi])
            total = _sums(self.table[f.words], f.word_starts) + _sums(np.where(f.valid, self.table[f.grams], 0.0), f.starts)
            n = np.diff(f.word_starts) + _sums(f.valid.astype(np.float64), f.starts)
            out.append(1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(n, 1.0) + self.bias, -700, 700))))
        return np.concatenate(out) if out else np.zeros(0)


def _bag_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, counts = [], []
        for text in grams.texts_of(batch.column("text")):
            f = features([text])
            b, n = np.unique(np.concatenate((f.words, f.grams[f.valid].astype(np.int64))), return_counts=True)
            buckets.append(b)
            counts.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
            names=["doc_id", "label", "buckets", "counts"],
        )


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE) -> QualityModel:
    """Stochastic gradient descent over ``(label, buckets, counts)`` in a seeded order."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1.0, 1.0, (1 << BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    steps, total = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            label, buckets, counts = bags[k]
            lr = rate * (1.0 - steps / total)
            steps += 1
            share = counts / max(1, counts.sum())
            hidden = share @ vectors[buckets] if len(buckets) else np.zeros(DIMENSIONS)
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            if len(buckets):
                vectors[buckets] -= (lr * share[:, None] * back[None, :]).astype(np.float32)
    return QualityModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled ids of ``labels(doc_id, label)`` with their texts."""
    agreed = (
        labels.where("doc_id is not null and label is not null")
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other and label in (0, 1)")
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    bags = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` pairs of numbers
        .select("doc_id", "label", "text")
        .mapInArrow(_bag_task, "doc_id long, label int, buckets array<int>, counts array<int>")
        .groupBy("doc_id").agg(F.min(F.struct("label", "buckets", "counts")).alias("bag"))
        .orderBy("doc_id").select("bag.*").toArrow()
    )
    return fit([
        (label, np.array(b, dtype=np.int64), np.array(n, dtype=np.float64))
        for label, b, n in zip(*(bags.column(c).to_pylist() for c in ("label", "buckets", "counts")))
    ])


def score(docs: DataFrame, model: QualityModel, keep: list[Column]) -> DataFrame:
    """The ``keep`` columns, ``score`` (probability of label 1) and ``predicted`` of ``docs(text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col("text").alias("_quality_text"))
    schema = source.drop("_quality_text").schema.add("score", "double").add("predicted", "integer")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(grams.texts_of(batch.column(batch.num_columns - 1)))
            columns = [*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(task, schema)


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 3) == 1


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from labels whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    return score(docs, train(docs, labels), [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])
