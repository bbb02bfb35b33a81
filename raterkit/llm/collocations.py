"""Phrase collocations by relational set mining: sorted occurrence relations, extended level by level.

The relation of level k holds (piece, position, phrase, last word) of every occurrence of a
frequent phrase of k words that has another beside it (what stands alone joins with nothing), sorted
and written as a table in blocks: a row is a run of occurrences of one language, its columns are
arrays, and positions leave a number out between pieces, so that neighbours never span two. Level k + 1 is the merge join of the relation with itself on
adjacent positions (a phrase can only be frequent if both its parts without an end word are),
counted by group in Spark; the groups that are frequent are joined back (semi-join) and the next
level is written. Counts are partial sums of tasks, so no word or phrase is one task's.

Groups are counted twice. The first count is by slot of a bit table of fixed size (``BITS``), the last
bits of a group's hash, and sorts out what cannot be frequent, which is most of it; the second is by
word, or by phrase and last word, over what is left, and is the result. Counts pass between tasks in
blocks, too: a row holds a task's counts of one range of slots, or of one part of the hashes, and slots
go as their distances, mostly a byte each. A task sums what is equal until its share of memory is full. The
semi-join goes through the bit table, which is all that is broadcast: a group that it lets through in
error (it shares a slot) costs time, never a result.
Relations name words and phrases by their hashes; phrases get their texts from joins of the
frequent groups. Scores are exact (38-digit decimals, integer division).

Null texts are empty, null languages ``und``. Repeated rows count as often as they stand. No
rows, or no phrase that is frequent: no rows. Columns other than text and lang are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raterkit.llm import grams
from raterkit.llm.grams import mix64
from raterkit.llm.tables import table
from raterkit.session import cut_lineage, scratch_path

LONGEST = 5
LEAST = 100
REPORTED = 2000
BITS = 1 << 27
BLOCK = 1 << 16  # slots of the bit table that are counted together
PARTS = 8  # exact counts of a language's phrases are dealt by so many bits of their hashes
CHUNK_BYTES = 1 << 18
WORDS_HELD = 1 << 20  # words, or pairs, that a task sums up before it passes counts on
SLOTS_HELD = 4  # times as many slots of the bit table, which take 5 bytes each

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_WORD, _BLANK, _BREAK = 0, 1, 2


def _classes() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[[0x20, 0x09]] = _BLANK
    kinds[list(_BREAKS)] = _BREAK
    return kinds


_KINDS = _classes()


def _word_ids(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: str) -> np.ndarray:
    """Hashes of the words ``points[start:end]`` of a language, none of them 0."""
    key = np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), dtype=np.uint64)
    ids = mix64(grams.span_hashes(points, starts, ends) ^ key).view(np.int64)
    ids[ids == 0] = 1
    return ids


def word_runs(texts: list[bytes], lang: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts as one, starts and ends of their words, the words' hashes, and these
    again with a 0 between words of different pieces (and after the last)."""
    joined = b".".join(texts).lower() + b"."
    points = np.frombuffer(joined, dtype=np.uint8)
    kinds = _KINDS[points]
    inside = np.concatenate(([False], kinds == _WORD, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    ids = _word_ids(points, starts, ends, lang)
    before = np.cumsum(kinds == _BREAK)[starts]
    parted = np.concatenate(([0], np.cumsum(before[1:] != before[:-1]))) if len(ids) else np.zeros(0, dtype=np.int64)
    run = np.zeros(len(ids) + (int(parted[-1]) if len(ids) else 0) + 1, dtype=np.int64)
    run[np.arange(len(ids)) + parted] = ids
    return joined, starts.astype(np.int32), ends.astype(np.int32), ids, run


def _in_lists(part: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The distinct values of ``part``, which is in order, and the columns as a list for each of them."""
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    at = pa.array(np.append(first, len(part)).astype(np.int32))
    return part[first], [pa.ListArray.from_arrays(at, c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on, a byte for each below 255, deflated."""
    far = numbers[numbers >= 255].astype("<u8")
    return zlib.compress(len(numbers).to_bytes(4, "little") + np.minimum(numbers, 255).astype(np.uint8).tobytes() + far.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    end = 4 + int.from_bytes(raw[:4], "little")
    numbers = np.frombuffer(raw[4:end], dtype=np.uint8).astype(np.int64)
    numbers[numbers == 255] = np.frombuffer(raw[end:], dtype="<u8").astype(np.int64)
    return numbers


SLOTS = "block int, slots binary, counts binary"


class SlotCounts:
    """How often ids fall in each slot of the bit table (``least`` stands for more), a row per block: the
    distances of its slots (of the first from the block's start) and their counts, both ``_packed``.
    Counts are summed until ``most`` slots are held; ids wait in lots of up to ``WORDS_HELD``."""

    def __init__(self, slots: int, least: int, most: int):
        self.slots, self.least, self.most = slots, least, most
        self.lot = min(most, WORDS_HELD)
        self._clear()

    def _clear(self) -> None:
        self.found, self.n = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.min_scalar_type(self.least))
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.waiting.append((ids & (self.slots - 1)).astype(np.uint32))
        self.size += len(ids)
        if self.size >= self.lot:
            self._sum()
            if len(self.found) >= self.most:
                yield from self.rest()

    def _sum(self) -> None:
        """Merge what waits into the slots held, which are in order."""
        new = np.sort(np.concatenate([np.zeros(0, dtype=np.uint32), *self.waiting]))
        first = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1]))) if len(new) else np.zeros(0, dtype=np.int64)
        n, new = np.diff(np.append(first, len(new))), new[first]
        at = np.searchsorted(self.found, new)
        held = np.zeros(len(new), dtype=bool)
        inside = at < len(self.found)
        held[inside] = self.found[at[inside]] == new[inside]
        self.n[at[held]] = np.minimum(self.n[at[held]].astype(np.int64) + n[held], self.least)
        self.found = np.insert(self.found, at[~held], new[~held])
        self.n = np.insert(self.n, at[~held], np.minimum(n[~held], self.least))
        self.waiting, self.size = [], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._sum()
        if len(self.found):
            block = self.found // BLOCK
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            steps = np.diff(self.found, prepend=self.found[:1])
            steps[first] = self.found[first] % BLOCK
            slots, counts = ([_packed(x[lo:hi]) for lo, hi in zip(first, [*first[1:], len(block)])] for x in (steps, self.n))
            rows = [pa.array(block[first].astype(np.int32)), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.record_batch(rows, names=["block", "slots", "counts"])
        self._clear()


SCAN = "kind string, lang string, count long, " + SLOTS
_SCAN = {"lang": pa.string(), "count": pa.int64(), "block": pa.int32(), "slots": pa.binary(), "counts": pa.binary()}


def _rows(of_kind: dict, kind: str, n: int, **columns) -> pa.RecordBatch:
    """Rows of one kind; columns that are not given are null."""
    out = {"kind": pa.array([kind] * n)}
    for name, of in of_kind.items():
        own = columns.get(name)
        out[name] = pa.nulls(n, of) if own is None else own if isinstance(own, pa.Array) else pa.array(own, of)
    return pa.record_batch(out)


def _texts_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, tuple]]:
    """``lang`` and ``word_runs`` of chunks of the texts that have words."""
    for batch in grams.slices(batches):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            for lo, hi in grams.chunks(own, CHUNK_BYTES):
                found = word_runs(own[lo:hi], lang)
                if len(found[3]):
                    yield lang, found


def _scan(most: int, slots: int, least: int) -> Callable:
    """How many words there are, and counts of words by slot of the bit table, summed until ``most`` slots
    are held."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals = SlotCounts(slots, least, most), {}

        def counted(own: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in own:
                yield _rows(_SCAN, "slots", b.num_rows, **dict(zip(b.schema.names, b.columns)))

        for lang, (*_, ids, _) in _texts_by_language(batches):
            totals[lang] = totals.get(lang, 0) + len(ids)
            yield from counted(held.add(ids))
        yield from counted(held.rest())
        yield _rows(_SCAN, "totals", len(totals), lang=list(totals), count=list(totals.values()))

    return scan


WORDS = "kind string, lang string, ids array<long>, part int, words binary, counts binary"
_WORDS = {"lang": pa.string(), "ids": pa.list_(pa.int64()), "part": pa.int32(), "words": pa.binary(), "counts": pa.binary()}


def _side_by_side(run: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The run with those of its words that are kept and have such a word beside them, a 0 after each stretch."""
    run = run.copy()
    run[np.flatnonzero(run)[~keep]] = 0
    word = np.concatenate(([False], run != 0, [False]))
    beside = word[1:-1] & (word[:-2] | word[2:])
    run[~beside] = 0
    return run[beside | np.concatenate(([False], beside[:-1]))]


def _add_words(sums: dict[tuple[bytes, int], int], held: list[tuple]) -> None:
    """Add the counts of the words of some chunks."""
    ids = np.concatenate([h[3] for h in held])
    if not len(ids):
        return
    found, first, n = np.unique(ids, return_index=True, return_counts=True)
    before = np.cumsum([0, *[len(h[3]) for h in held]])
    words: list[bytes] = [b""] * len(found)
    order = np.argsort(first)
    cuts = np.searchsorted(first[order], before)
    for h, base, lo, hi in zip(held, before, cuts, cuts[1:]):  # chunk by chunk
        at = first[order[lo:hi]] - base
        for k, s, e in zip(order[lo:hi].tolist(), h[1][at].tolist(), h[2][at].tolist()):
            words[k] = h[0][s:e]
    for key, k in zip(zip(words, found.tolist()), n.tolist()):
        sums[key] = sums.get(key, 0) + k


def _word_parts(lang: str, sums: dict[tuple[bytes, int], int]) -> pa.RecordBatch:
    """Words in order with a blank between them and their counts, a row per part."""
    own = sorted(sums.items())
    part = (np.array([i for (_, i), _ in own], dtype=np.int64).view(np.uint64) >> np.uint64(64 - PARTS)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1])))
    words, counts = [], []
    for at in np.split(order, first[1:]):
        words.append(zlib.compress(b" ".join([own[k][0][0] for k in at]), 1))
        counts.append(_packed(np.array([own[k][1] for k in at], dtype=np.int64)))
    return _rows(_WORDS, "words", len(first), lang=[lang] * len(first), part=part[order][first], words=words, counts=counts)


def _frequent_words(often, most: int) -> Callable:
    """Runs of the words in the bit table, a row per chunk of texts, and counts of them with their texts,
    summed until ``most`` words are held."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        sums: dict[str, dict] = {}
        size = 0

        def added() -> None:
            for name, parts in held.items():
                _add_words(sums.setdefault(name, {}), parts)
            held.clear()

        def passed_on() -> Iterator[pa.RecordBatch]:
            for name, own in sums.items():
                if own:
                    yield _word_parts(name, own)
            sums.clear()

        for lang, (joined, starts, ends, ids, run) in _texts_by_language(batches):
            keep = _among(often.value, ids)
            run = _side_by_side(run, keep)
            if len(run):
                yield _rows(_WORDS, "runs", 1, lang=[lang], ids=[run])
            held.setdefault(lang, []).append((joined, starts[keep], ends[keep], ids[keep]))
            size += len(ids)
            if size >= most:
                added()
                size = 0
                if sum(map(len, sums.values())) >= most:
                    yield from passed_on()
        added()
        yield from passed_on()

    return count


def _frequent_words_in_part(least: int) -> Callable:
    """The words of a language and part that are found ``least`` times or more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        lang = None
        for batch in batches:
            lang = batch.column("lang")[0].as_py() if batch.num_rows else lang
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                for word, n in zip(zlib.decompress(words).split(b" "), _unpacked(counts).tolist(), strict=True):
                    sums[word] = sums.get(word, 0) + n
        often = [word for word, n in sums.items() if n >= least]
        for lo, hi in grams.chunks(often, CHUNK_BYTES):
            words = often[lo:hi]
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(sizes + 1) - 1
            ids = _word_ids(np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8), ends - sizes, ends, lang)
            f = pa.array([sums[word] for word in words], pa.int64())
            yield pa.record_batch({"lang": pa.array([lang] * len(words), pa.string()), "id": pa.array(ids), "phrase": pa.array(words, pa.binary()).cast(pa.string()), "f": f})

    return add


def _extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its beginning and of its last word."""
    with np.errstate(over="ignore"):
        return mix64(prefix.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)).view(np.int64)


def _among(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64)) & 1 == 1


def _occurrences(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """``lang, position, phrase, last word`` of each row of a relation; level 1 is the runs of words."""
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].values.to_numpy() for c in batch.schema.names if c != "lang"}
        lang = batch.column("lang")[i].as_py()
        if "ids" in row:
            at = np.flatnonzero(row["ids"])
            yield lang, at.astype(np.int32), row["ids"][at], row["ids"][at]
        else:
            yield lang, row["position"], row["phrase"], row["last"]


def _adjacent(batch: pa.RecordBatch, bits: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The merge join of each row with itself on adjacent positions: ``lang, position, phrase, next word``
    and hash of the joint phrase. Occurrences of phrases that are not frequent are left out first."""
    for lang, position, phrase, last in _occurrences(batch):
        keep = _among(bits, phrase)
        position, phrase, last = position[keep], phrase[keep], last[keep]
        at = np.flatnonzero(position[1:] - position[:-1] == 1)
        if len(at):
            yield lang, position[at], phrase[at], last[at + 1], _extended(phrase[at], last[at + 1])


def _phrase_slots(bits, most: int, slots: int, least: int) -> Callable:
    """Counts of joint phrases by slot of the bit table, summed until ``most`` slots are held."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = SlotCounts(slots, least, most)
        for batch in batches:
            for *_, joint in _adjacent(batch, bits.value):
                yield from held.add(joint)
        yield from held.rest()

    return count


LEVEL = "kind string, lang string, part int, position array<int>, phrase array<long>, last array<long>, count array<long>"
_LEVEL = {"lang": pa.string(), "part": pa.int32(), "position": pa.list_(pa.int32()), **{c: pa.list_(pa.int64()) for c in ("phrase", "last", "count")}}


def _summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of (phrase, next word), each once and in order."""
    prefix, word, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((word, prefix))
    prefix, word, n = prefix[order], word[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1]))))
    return prefix[first], word[first], np.add.reduceat(n, first)


def _next_level(bits, frequent, most: int, further: bool) -> Callable:
    """The relation of the next level, if a ``further`` one follows, and exact partial counts of its phrases
    in parts by their hashes, summed until half of ``most`` are held."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        size = 0

        def summed() -> int:
            for name, parts in held.items():
                held[name] = [_summed(parts)]
            return sum(len(x[0]) for (x,) in held.values())

        def passed_on() -> Iterator[pa.RecordBatch]:
            for name, ((prefix, word, n),) in held.items():
                part = (_extended(prefix, word).view(np.uint64) >> np.uint64(64 - PARTS)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, (prefix, word, n) = _in_lists(part[order], prefix[order], word[order], n[order])
                yield _rows(_LEVEL, "counts", len(part), lang=[name] * len(part), part=pa.array(part), phrase=prefix, last=word, count=n)
            held.clear()

        for batch in batches:
            for lang, position, phrase, last, joint in _adjacent(batch, bits.value):
                keep = _among(frequent.value, joint)
                if keep.any():
                    position, phrase, last, joint = position[keep], phrase[keep], last[keep], joint[keep]
                    held.setdefault(lang, []).append((phrase, last, np.ones(len(joint), dtype=np.int64)))
                    size += len(joint)
                    next_to = np.concatenate(([False], position[1:] - position[:-1] == 1, [False]))
                    beside = next_to[1:] | next_to[:-1]
                    if further and beside.any():
                        yield _rows(_LEVEL, "occurrences", 1, lang=[lang], position=[position[beside].astype(np.int32)], phrase=[joint[beside]], last=[last[beside]])
                if size >= most:
                    size = summed()
                    if size >= most // 2:
                        yield from passed_on()
                        size = 0
        summed()
        yield from passed_on()

    return extend


PHRASES = "lang string, prefix long, word long, id long, f long"


def _frequent_in_part(most: int, least: int) -> Callable:
    """The phrases of a language and part that are found ``least`` times or more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, limit, lang = 0, most, None
        for batch in batches:
            lang = batch.column("lang")[0].as_py() if batch.num_rows else lang
            held.append(tuple(batch.column(c).flatten().to_numpy() for c in ("phrase", "last", "count")))
            size += len(held[-1][0])
            if size >= limit:
                held = [_summed(held)]
                size = len(held[0][0])
                limit = most + 2 * size
        prefix, word, n = _summed(held)
        prefix, word, n = (x[n >= least] for x in (prefix, word, n))
        ids = _extended(prefix, word)
        yield pa.record_batch({"lang": pa.array([lang] * len(n), pa.string()), "prefix": pa.array(prefix), "word": pa.array(word), "id": pa.array(ids), "f": pa.array(n)})

    return add


def _often_in_block(least: int) -> Callable:
    """The 64-bit words of the bit table with slots that are found ``least`` times or more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, block = np.zeros(BLOCK, dtype=np.int64), 0
        for batch in batches:
            block = batch.column("block")[0].as_py() if batch.num_rows else block
            for slots, counts in zip(batch.column("slots").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                found[np.cumsum(_unpacked(slots))] += _unpacked(counts)  # each slot once in a row
        bits = np.packbits(found >= least, bitorder="little").view("<i8")
        at = np.flatnonzero(bits)
        yield pa.record_batch({"at": pa.array((block * (BLOCK // 64) + at).astype(np.int32)), "bits": pa.array(bits[at])})

    return add


def _broadcast_bits(spark: SparkSession, rows: DataFrame):
    """The bit table of rows ``at, bits`` (``BITS / 64`` at most)."""
    rows = rows.toArrow()
    found = np.zeros(max(1, BITS // 64), dtype=np.int64)
    found[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return spark.sparkContext.broadcast(found)


def _often_table(spark: SparkSession, blocks: DataFrame, least: int):
    """The slots that were counted ``least`` times or more as a broadcast bit table."""
    return _broadcast_bits(spark, blocks.groupBy("block").applyInArrow(_often_in_block(least), "at int, bits long"))


def _bit_table(spark: SparkSession, frequent: DataFrame):
    """The ids of ``frequent`` as a broadcast table of ``BITS`` bits."""
    slot = F.col("id").bitwiseAND(F.lit(BITS - 1))
    one = F.expr("shiftleft(1L, cast(id & 63 as int))")
    return _broadcast_bits(spark, frequent.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(one).alias("bits")))


def _parts(spark: SparkSession, rows: DataFrame, name: str) -> Callable:
    """Write rows of several kinds once; each kind is read from a folder of its own."""
    path = scratch_path(spark, name)
    rows.write.partitionBy("kind").parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    return lambda kind, *columns: written.where(F.col("kind") == kind).select(*columns)


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of up to ``LONGEST`` words found ``least`` times or
    more, and ``lang, n``, the count of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scanned = _parts(spark, texts.mapInArrow(_scan(SLOTS_HELD * WORDS_HELD, BITS, least), SCAN), "words")
    totals = scanned("totals", "lang", "count").groupBy("lang").agg(F.sum("count").alias("n"))
    often = _often_table(spark, scanned("slots", "block", "slots", "counts"), least)
    of_words = _parts(spark, texts.mapInArrow(_frequent_words(often, WORDS_HELD), WORDS), "level-1")
    counts = of_words("words", "lang", "part", "words", "counts")
    words = cut_lineage(counts.groupBy("lang", "part").applyInArrow(_frequent_words_in_part(least), "lang string, id long, phrase string, f long"), "frequent")
    often.destroy()
    last_words = words.select("lang", F.col("id").alias("word"), F.col("phrase").alias("last_word"))
    relation, level, found = of_words("runs", "lang", "ids"), words, [words.select("lang", "phrase", F.lit(1).alias("words"), "f")]
    for k in range(2, LONGEST + 1):
        bits = _bit_table(spark, level)
        blocks = relation.mapInArrow(_phrase_slots(bits, SLOTS_HELD * WORDS_HELD, BITS, least), SLOTS)
        often = _often_table(spark, blocks, least)
        of_level = _parts(spark, relation.mapInArrow(_next_level(bits, often, WORDS_HELD, k < LONGEST), LEVEL), f"level-{k}")
        for table_of_bits in (bits, often):  # what they serve is written; on disk they are 16 MB for every process
            table_of_bits.destroy()
        counts = of_level("counts", "lang", "part", "phrase", "last", "count")
        exact = counts.groupBy("lang", "part").applyInArrow(_frequent_in_part(WORDS_HELD, least), PHRASES)
        starts = level.select("lang", F.col("id").alias("prefix"), F.col("phrase").alias("start"))
        named = exact.join(starts, ["lang", "prefix"]).join(last_words, ["lang", "word"])
        level = cut_lineage(named.select("lang", "id", F.concat_ws(" ", "start", "last_word").alias("phrase"), "f"), "frequent")
        found.append(level.select("lang", "phrase", F.lit(k).alias("words"), "f"))
        relation = of_level("occurrences", "lang", "position", "phrase", "last")
        if level.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, totals


def collocations(docs: DataFrame, least: int = LEAST, reported: int = REPORTED) -> DataFrame:
    """Each language's first ``reported`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    every, totals = frequent_phrases(docs, least)
    candidates = every.where("words >= 2")
    split = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), split.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"),
    )
    counts = every.select("lang", "phrase", "f")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    whole = {c: f"cast({c} as decimal(20, 0))" for c in "alrn"}
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {whole['a']} * {whole['n']}) div ({whole['l']} * {whole['r']})")
    best = cuts.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r")).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    inner = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(split, i, k), " "))))
    inside = candidates.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a")
    by_score = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(by_score).cast("long")).where(F.col("rank") <= reported)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest-scoring phrases of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))
