"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the character 1-, 2- and 3-grams of letters (lower case; anything else counts as
a word border), hashed into ``2**BITS`` buckets. Training counts every gram of every training
document in Spark: each task adds up one count vector per language, and the sums over tasks
are an aggregate. The log-probability matrix has languages x 2**BITS numbers, whatever the
corpus size, and is broadcast. Scoring gathers the columns of each text's grams and adds them
per text. A text without a letter, null or empty, is ``und`` with score 0. Languages tie by
name. With no training rows every text is ``und``. Repeated rows count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raterkit.llm import grams
from raterkit.llm.tables import id_remainder, table

BITS = 15
SMOOTHING = 0.5
MAX_LANGUAGES = 1000
LANGUAGES_HELD = 64  # languages whose counts a task sums up before it passes them on
UNDETERMINED = "und"
FAMILIAR_DOCS = 0.005  # an n-gram is familiar to a language if this share of its documents has it
FAMILIAR_GRAMS = 0.5  # a text is in a language if this share of its n-grams is familiar

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def hashed_grams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram, and the number of n-grams before each text (last: all)."""
    points, starts = grams.code_points([t.lower() for t in texts])
    letter = _letter_table()[points]
    c = np.concatenate((np.zeros(1, np.uint32), np.where(letter, points, 0), np.zeros(1, np.uint32))).astype(np.uint32)
    at = np.flatnonzero(letter)  # the grams of a letter: itself, with the next, and with both neighbours
    b, m, e = c[at], c[at + 1], c[at + 2]
    k1, k2, k3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    out = np.empty((len(at), 3), dtype=np.uint32)
    both = m * k2 + e * k3
    out[:, 0] = m * k1 + np.uint32(0x68E31DA4)
    out[:, 1] = both + np.uint32(0x27D4EB2F)
    out[:, 2] = both + b * k1 + np.uint32(0x165667B1)
    out >>= np.uint32(32 - bits)  # the upper bits of a product are the mixed ones
    return out.reshape(-1), 3 * np.searchsorted(at, starts)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    having: dict[str, np.ndarray] = {}  # documents with an n-gram
    docs: dict[str, int] = {}

    def summed() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(used) + 1)),
                "bucket": pa.array(np.concatenate(([-1], used)), pa.int32()),  # -1: documents
                "n": pa.array(np.concatenate(([docs[lang]], own[used])), pa.int64()),
                "docs": pa.array(np.concatenate(([docs[lang]], having[lang][used])), pa.int64()),
            })
        for held in (counts, having, docs):
            held.clear()

    for batch in grams.slices(batches):
        langs = batch.column("lang").to_pylist()
        texts = grams.texts_of(batch.column("text"))
        order = sorted(range(len(langs)), key=lambda i: langs[i])
        langs, texts = [langs[i] for i in order], [texts[i] for i in order]
        for lo, hi in grams.chunks(texts):
            buckets, at = hashed_grams(texts[lo:hi])
            present = np.zeros((hi - lo, 1 << BITS), dtype=bool)  # ``grams.ROWS_READ`` rows at most
            present[np.repeat(np.arange(hi - lo), np.diff(at)), buckets] = True
            i = lo
            while i < hi:
                j = i
                while j < hi and langs[j] == langs[i]:
                    j += 1
                own = np.bincount(buckets[at[i - lo] : at[j - lo]], minlength=1 << BITS)
                counts[langs[i]] = counts.get(langs[i], 0) + own
                having[langs[i]] = having.get(langs[i], 0) + present[i - lo : j - lo].sum(axis=0)
                docs[langs[i]] = docs.get(langs[i], 0) + j - i
                i = j
        if len(counts) > LANGUAGES_HELD:
            yield from summed()
    yield from summed()


@dataclass
class LanguageModel:
    """``langs`` in order; ``weights[lang, bucket]`` are log probabilities; ``priors[lang]``;
    ``familiar[lang, bucket]``: whether enough of the language's documents have the n-gram."""

    langs: list[str]
    weights: np.ndarray
    priors: np.ndarray
    familiar: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """As ``predict``, and whether the text is in the language named: whether ``FAMILIAR_GRAMS`` of its
        n-grams are familiar to that language."""
        names, scores, known = [], [], []
        for lo, hi in grams.chunks(texts):
            buckets, at = hashed_grams(texts[lo:hi])
            n = np.diff(at)
            if not self.langs:
                names += [UNDETERMINED] * (hi - lo)
                scores.append(np.zeros(hi - lo))
                known.append(np.zeros(hi - lo, dtype=bool))
                continue
            sums = np.zeros((hi - lo, len(self.langs)))
            full = np.flatnonzero(n)
            if len(full):
                for k in range(len(self.langs)):
                    sums[full, k] = np.add.reduceat(self.weights[k][buckets], at[:-1][full], dtype=np.float64)
            sums += self.priors
            best = sums.argmax(axis=1)
            hits = np.zeros(hi - lo)
            if len(full):
                own = self.familiar[np.repeat(best, n), buckets]
                hits[full] = np.add.reduceat(own, at[:-1][full], dtype=np.float64)
            known.append((n > 0) & (hits >= FAMILIAR_GRAMS * n))
            posterior = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            names += [self.langs[b] if c else UNDETERMINED for b, c in zip(best, n)]
            scores.append(np.where(n > 0, posterior, 0.0))
        if not scores:
            return names, np.zeros(0), np.zeros(0, dtype=bool)
        return names, np.concatenate(scores), np.concatenate(known)


def train(labelled: DataFrame) -> LanguageModel:
    """Fit on every row of ``labelled(text, lang)`` with a language and a text.

    The result of the aggregate (languages x 2**BITS counts at most) is the model itself.
    """
    rows = labelled.select("text", "lang").where("lang is not null and text is not null")
    n_langs = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n_langs > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages; the model is broadcast and has a bounded size")
    counted = rows.mapInArrow(_count_task, "lang string, bucket int, n long, docs long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toArrow()
    langs = sorted(set(summed.column("lang").to_pylist()))
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(langs), 1 << BITS))
    docs = np.zeros(len(langs))
    which = np.array([place[x] for x in summed.column("lang").to_pylist()], dtype=np.int64)
    bucket, n = summed.column("bucket").to_numpy(), summed.column("n").to_numpy()
    grams_only = bucket >= 0
    counts[which[grams_only], bucket[grams_only]] = n[grams_only]
    docs[which[~grams_only]] = n[~grams_only]
    total = counts.sum(axis=1, keepdims=True)
    weights = np.log(counts + SMOOTHING) - np.log(total + SMOOTHING * (1 << BITS))
    priors = np.log(docs) - np.log(max(docs.sum(), 1.0)) if langs else docs
    having = np.zeros(counts.shape)
    having[which[grams_only], bucket[grams_only]] = summed.column("docs").to_numpy()[grams_only]
    return LanguageModel(langs, weights.astype(np.float32), priors, (having > 0) & (having >= FAMILIAR_DOCS * docs[:, None]))


def identify(
    docs: DataFrame, model: LanguageModel, keep: list[Column], names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The ``keep`` columns, the language and its probability for every row of ``docs(text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col("text").alias("_lid_text"))
    schema = source.drop("_lid_text").schema.add(names[0], "string").add(names[1], "double")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grams.slices(batches):
            langs, scores = shared.value.predict(grams.texts_of(batch.column(batch.num_columns - 1)))
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(task, schema)


HELD_OUT = 5


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, HELD_OUT) == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: Sequence[str] | None = None) -> DataFrame:
    """Pipeline stage: the model decides which documents stay.

    Documents go whose text is in none of the languages that the model has learned from the stage's own
    input (``LanguageModel.judge``: most of its n-grams are not familiar to the likeliest language;
    texts without a letter, null and empty ones are in none), and with ``languages`` also those in
    another language. With no labelled row there is no model: then
    only texts without a letter go. Columns and texts are left as they are.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    model = train(docs.where(~held_out(F.col("doc_id"))))
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    shared, at, schema = spark.sparkContext.broadcast(model), docs.columns.index("text"), docs.schema
    wanted = None if languages is None else set(languages)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grams.slices(batches):
            names, _, known = shared.value.judge(grams.texts_of(batch.column(at)))
            keep = known if wanted is None else known & np.array([x in wanted for x in names], dtype=bool)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(*columns).mapInArrow(task, schema)
