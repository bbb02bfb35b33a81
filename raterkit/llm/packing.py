"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Documents are tokenised where they lie; only those longer than a sequence are cut. What the
driver plans on is the histogram of piece lengths: at most ``size`` counts, however many
pieces there are. Starting from the longest length left, the gap of a sequence is looked up
among the available lengths: one that fills it exactly, else a pair, else a triple with that
sum (availability counts respected); where none exists, the longest length that still fits is
placed (best fit) and the rest of the gap looked up again. Each combination is used as often
as the counts allow, so each step uses up one length and the plan has a bounded number of
steps. The plan's slots say which ranks of a length go where; pieces get their ranks from
counts over (length, shard), so that a length that most pieces share is not one task.

Null and empty texts are one end-of-text token. Repeated rows are packed as often as they
stand. An empty table gives no rows.
"""

from __future__ import annotations

import gc
import itertools
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterkit.llm import grams
from raterkit.llm.tables import table
from raterkit.session import cut_lineage

SEQUENCE = 4096
END = 1
SHARDS = 256
WORDS_KEPT = 600_000
KEY_KEPT = 64

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- tokenising -------------------------------------------------------------------------

# The tokenizer's own split into words, for text of the characters below (fixed values).
_LATIN = "a-zß-öø-ÿ"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\t-\r {_LATIN}0-9]+").findall
_FOREIGN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]").search


def _plain(text: str) -> bool:
    """Only characters whose normal form, lower case and class are certain; no special token."""
    return "<|" not in text and not _FOREIGN(text)


def _byte_symbols() -> dict[int, str]:
    """Symbol that byte-level tokenizers write for each byte that has no printable one."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}


class Recent(dict):
    """Values made on first use, in two generations: what was used since the last turn outlives
    the next one. Keys longer than ``KEY_KEPT`` are made anew each time, so the bytes held are bounded."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(key) > KEY_KEPT:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Ids of whole texts, equal to the tokenizer's own, with ids of words remembered.

    A text of plain characters (ASCII and Latin letters) is lower-cased and split into the
    tokenizer's words here, and each new word is one call of its model. In any other text the
    chunks between ASCII white space, which the tokenizer never joins, are taken one by one:
    plain ones as above, the others through the whole tokenizer.
    """

    def __init__(self, vocabulary: str, most: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = _byte_symbols()
        self.words, self.others = Recent(self._word, most), Recent(self._chunk, most // 4)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.symbols)
        tokens = self.model.tokenize(word)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _chunk(self, chunk: bytes) -> bytes:
        own = chunk.decode("utf-8", "surrogatepass")
        if _plain(own):
            return b"".join(self._word(w) for w in _PIECES(own.lower()))
        ids = self.tokenizer.encode(own, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if _plain(text):
            ids = b"".join(map(self.words.__getitem__, _PIECES(text.lower())))
        else:
            ids = b"".join(map(self.others.__getitem__, text.encode("utf-8", "surrogatepass").split()))
        self.words.turn()
        self.others.turn()
        return ids


_encoders: dict[str, WordEncoder] = {}


def _encoder(vocabulary: str) -> WordEncoder:
    if vocabulary not in _encoders:
        gc.set_threshold(1_000_000)  # the words remembered are no cycles, but many
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece of each row of ``docs(doc_id, text)``, with the crc32 of its ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = _encoder(vocabulary), np.array([end], dtype="<u4").tobytes()
        for batch in grams.slices(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for doc, text in zip(ids, grams.texts_of(batch.column("text"))):
                data = encoder.encode(text) + tail
                for k in range(0, len(data), 4 * size):
                    part = data[k : k + 4 * size]
                    rows.append((doc, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    cut = docs.select("doc_id", "text").mapInArrow(task, PIECES)
    return cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SHARDS)).cast("int"))


# --- planning ---------------------------------------------------------------------------


@dataclass
class Slot:
    """Ranks ``first .. first + copies * sequences - 1`` of ``length``: ``copies`` in each of
    the sequences from ``sequence`` on, from ``offset`` on."""

    length: int
    first: int
    copies: int
    sequences: int
    sequence: int
    offset: int


def _exact(counts: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths with the sum ``gap``; longest first."""
    if counts[gap]:
        return [gap]
    have = counts > 0

    def pair(total: int) -> list[int] | None:
        if total < 2:
            return None
        high = np.arange(total - 1, (total - 1) // 2, -1)
        fits = have[high] & have[total - high] & ((high * 2 != total) | (counts[high] > 1))
        k = int(fits.argmax()) if len(fits) else 0
        return [int(high[k]), int(total - high[k])] if len(fits) and fits[k] else None

    found = pair(gap)
    if found:
        return found
    for x in np.flatnonzero(have[: gap - 1])[::-1]:
        if 3 * x < gap:
            break
        rest = pair(gap - int(x))
        if rest and max(rest) <= x:
            three = [int(x), *rest]
            if all(counts[v] >= three.count(v) for v in three):
                return three
    return None


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[Slot]:
    """Slots for all pieces of the histogram ``length -> pieces``."""
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used = np.zeros(size + 1, dtype=np.int64)
    slots: list[Slot] = []
    sequence = 0
    while counts.any():
        first = int(np.flatnonzero(counts)[-1])
        items, gap = [first], size - first
        counts[first] -= 1
        while gap:
            exact = _exact(counts, gap)
            if exact:
                items += exact
                for x in exact:
                    counts[x] -= 1
                break
            fitting = np.flatnonzero(counts[: gap + 1])
            if not len(fitting):
                break
            best = int(fitting[-1])
            copies = min(gap // best, int(counts[best]))
            copies = max(1, copies - 1)  # the last one may give way to an exact combination
            items += [best] * copies
            counts[best] -= copies
            gap -= copies * best
        runs = [(x, len(list(g))) for x, g in itertools.groupby(items)]
        need: dict[int, int] = {}
        for x, n in runs:
            need[x] = need.get(x, 0) + n
        times = 1 + min(int(counts[x]) // n for x, n in need.items())
        offset = 0
        for x, n in runs:
            slots.append(Slot(x, int(used[x]), n, times, sequence, offset))
            used[x] += n * times
            offset += x * n
        for x, n in need.items():
            counts[x] -= n * (times - 1)
        sequence += times
    return slots


# --- placing ----------------------------------------------------------------------------


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of
    ``docs(doc_id, text)``. The tokenised pieces (a few numbers each) are written once to the
    shared checkpoint folder."""
    cut = cut_lineage(pieces(docs, vocabulary or default_vocabulary(), size, end), "pieces")
    shards = cut.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")).toArrow()
    length, shard, n = (shards.column(c).to_numpy() for c in ("length", "shard", "n"))
    order = np.lexsort((shard, length))
    length, shard, n = length[order], shard[order], n[order]
    per_length = np.bincount(length, weights=n, minlength=size + 1).astype(np.int64)
    before = np.cumsum(n) - n - (np.cumsum(per_length) - per_length)[length]  # ranks of a length before a shard
    slots = plan({int(x): int(per_length[x]) for x in np.flatnonzero(per_length)}, size)
    slots.sort(key=lambda s: (s.length, s.first))
    fields = np.array([(s.length, s.first, s.copies, s.sequence, s.offset) for s in slots], dtype=np.int64).reshape(-1, 5)
    shared = cut.sparkSession.sparkContext.broadcast((length * SHARDS + shard, before, fields))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start_rank, slot = shared.value
        seen: dict[int, int] = {}
        for batch in batches:
            key = batch.column("length").to_numpy() * SHARDS + batch.column("shard").to_numpy()
            own = batch.column("length").to_numpy()
            values, inverse = np.unique(key, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            group = inverse[order]
            firsts = np.searchsorted(group, np.arange(len(values)))
            within = np.empty(len(key), dtype=np.int64)
            within[order] = np.arange(len(key)) - firsts[group]
            base = start_rank[np.searchsorted(known, values)]
            base = base + np.array([seen.get(int(v), 0) for v in values], dtype=np.int64)
            for v, c in zip(values, np.bincount(inverse)):
                seen[int(v)] = seen.get(int(v), 0) + int(c)
            rank = base[inverse] + within
            # the slot of a rank: the last one of the length that starts at or before it
            at = np.searchsorted(slot[:, 0] * (1 << 44) + slot[:, 1], own * (1 << 44) + rank, side="right") - 1
            _, first, copies, sequence, offset = slot[at].T
            sequence_id = sequence + (rank - first) // copies
            place_at = offset + (rank - first) % copies * own
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence_id), pa.array(place_at)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    # in an order of their own, so that a task that runs again gives every piece the same rank
    order = ["length", "shard", "doc_id", "piece", "start", "ids_crc32"]
    dealt = cut.repartition("length", "shard").sortWithinPartitions(*order)
    return dealt.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents that are left, packed."""
    return pack(docs)
