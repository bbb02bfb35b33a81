"""Byte-pair encoding and decoding of whole texts by tree concatenation.

Texts of up to ``LEAF`` characters are encoded at once. A longer one is cut into leaves that
are encoded as rows of their own, in parallel; then neighbours are concatenated pairwise, round
by round, until one row per text is left. At a join, the tokens around it are replaced by the
encoding of a window over both sides:

* where white space follows other characters there is a word border whatever stands around
  it, so a window from the last such place on the left to the first on the right is exact;
* in a long run without one, the window starts with a few tokens of each side and doubles
  until its first and last tokens agree with those already there (a sequence of byte-pair
  tokens is valid if each pair of neighbours is), up to the window above.

Only ids travel between rounds. Null and empty texts have no ids. Repeated rows give repeated
results; an empty table none. A special token's string in a text becomes that token, as in the
tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterkit.llm import grams
from raterkit.llm.packing import _byte_symbols
from raterkit.llm.tables import table
from raterkit.session import cut_lineage

LEAF = 1 << 15
WINDOW = 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _white(byte: int) -> bool:
    return byte in (9, 10, 11, 12, 13, 32)


class ByteCodec:
    """Encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = {chr(b): b for b in range(256) if b not in _byte_symbols()} | {c: b for b, c in _byte_symbols().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        for text, i in self.special.items():
            self.bytes[i] = text.encode()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode(text, allowed_special="all"), dtype="<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def _border_left(self, ids: np.ndarray) -> int:
        """Index of the last token that begins with white space after another character (0: none)."""
        for i in range(len(ids) - 1, 0, -1):
            if _white(self.bytes[ids[i]][0]) and not _white(self.bytes[ids[i - 1]][-1]) and self.bytes[ids[i - 1]][-1] < 128:
                return i
        return 0

    def _border_right(self, ids: np.ndarray) -> int:
        """Index of the first such token (none: the number of tokens)."""
        for i in range(1, len(ids)):
            if _white(self.bytes[ids[i]][0]) and not _white(self.bytes[ids[i - 1]][-1]) and self.bytes[ids[i - 1]][-1] < 128:
                return i
        return len(ids)

    def _whole_characters(self, ids: np.ndarray, i: int, step: int) -> int:
        """The next index from ``i`` on, in steps, at which a token begins with a character."""
        while 0 < i < len(ids) and 0x80 <= self.bytes[ids[i]][0] < 0xC0:
            i += step
        return min(max(i, 0), len(ids))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the concatenated texts, given the ids of both."""
        if not len(left) or not len(right):
            return np.concatenate((left, right))
        low, high, width = self._border_left(left), self._border_right(right), WINDOW
        while True:
            s = max(low, self._whole_characters(left, len(left) - width, -1))
            e = min(high, self._whole_characters(right, width, 1))
            text = self.decode_bytes(left[s:]) + self.decode_bytes(right[:e])
            window = self.encode(text.decode("utf-8"))
            agree_left = s == low or np.array_equal(window[:2], left[s : s + 2]) and len(left) - s > 4
            agree_right = e == high or np.array_equal(window[-2:], right[e - 2 : e]) and e > 4
            if agree_left and agree_right:
                return np.concatenate((left[:s], window, right[e:]))
            width *= 2


_codecs: dict[str, ByteCodec] = {}


def codec(vocabulary: str) -> ByteCodec:
    if vocabulary not in _codecs:
        _codecs[vocabulary] = ByteCodec(vocabulary)
    return _codecs[vocabulary]


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(c: ByteCodec, ids: np.ndarray) -> tuple[int, str, str]:
    text = c.decode(ids).encode("utf-8", "surrogatepass")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()


def encode_long(docs: DataFrame, vocabulary: str, leaf: int = LEAF) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit integers) of ``docs(doc_id, text)`` by leaves and joins."""
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{leaf}}}"), F.lit(0))  # one pass over the text
    cut = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(parts).alias("seg", "part"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            ids = [c.encode(t).tobytes() for t in grams.texts_of(batch.column("part"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["doc_id", "h", "seg", "ids"])

    def joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            pairs = zip(batch.column("l").to_pylist(), batch.column("r").to_pylist())
            ids = [
                l if r is None else c.join(np.frombuffer(l, dtype="<u4"), np.frombuffer(r, dtype="<u4")).astype("<u4").tobytes()
                for l, r in pairs
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], names=["doc_id", "h", "seg", "copies", "ids"])

    dealt = cut.repartition("doc_id", "h", "seg")
    level = cut_lineage(dealt.mapInArrow(leaves, "doc_id long, h long, seg int, ids binary"), "leaves").withColumn("copies", F.lit(1).cast("long"))
    last = level.agg(F.max("seg")).head()[0]
    while last:
        even = F.col("seg") % 2 == 0
        paired = level.groupBy("doc_id", "h", F.shiftright("seg", 1).alias("seg")).agg(
            F.sum(F.when(even, F.col("copies"))).alias("copies"),
            F.max(F.when(even, F.col("ids"))).alias("l"),
            F.max(F.when(~even, F.col("ids"))).alias("r"),
        )
        level = paired.mapInArrow(joins, "doc_id long, h long, seg int, copies long, ids binary")
        last >>= 1
    return level.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "ids").drop("copy")


def encode(docs: DataFrame, vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text decoded from them."""
    vocabulary = vocabulary or default_vocabulary()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            yield _rows(batch.column("doc_id"), [_digest(c, c.encode(t)) for t in grams.texts_of(batch.column("text"))])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            yield _rows(batch.column("doc_id"), [_digest(c, np.frombuffer(b, dtype="<u4")) for b in batch.column("ids").to_pylist()])

    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.char_length("text") > leaf
    return (
        source.where(~is_long).mapInArrow(short, DIGESTS)
        .unionByName(encode_long(source.where(is_long), vocabulary, leaf).mapInArrow(long, DIGESTS))
    )


def _rows(ids: pa.Array, digests: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, a, b = zip(*digests) if digests else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encode(table(spark, sf_dir, "documents"))
