"""Numpy helpers shared by the text operators: one array of code points per batch of texts.

``Text`` columns arrive as Arrow arrays; each helper works on a chunk of characters
that fits the processor's cache, so memory stays bounded however long the texts are in total.
A single text is never cut: a chunk holds at least one whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_CHARS = 250_000
ROWS_READ = 256  # rows whose texts are taken from a batch at a time
SEPARATOR = "\n"


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of at most ``most`` characters, or one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``ROWS_READ`` rows, so that a task never holds all texts of a batch as strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_READ):
            yield batch.slice(at, ROWS_READ)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by one separator, and the start of each text
    (with the total length as last entry)."""
    joined = SEPARATOR.join(texts) + SEPARATOR
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return points, np.concatenate(([0], np.cumsum(lengths)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _geometric(factor: int, size: int) -> np.ndarray:
    out = np.full(size, factor, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 19)
        _powers, _inverse = _geometric(_BASE, size), _geometric(pow(_BASE, -1, 1 << 64), size)
    return _powers, _inverse


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``points[start:end]``, equal for equal content wherever it stands
    (polynomial modulo 2**64 over mixed symbols, from one running sum)."""
    powers, inverse = _power_tables(len(points) + 1)
    symbols = mix64(points.astype(np.uint64) + np.uint64(0x51ED2701))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * powers[: len(points)], dtype=np.uint64)))
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


WHITE = np.zeros(0x110000, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space."""
    inside = np.concatenate(([False], ~WHITE[points], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]
