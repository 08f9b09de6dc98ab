"""Words of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

#: Bytes of text taken at a time; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes hashed at a time, also of one long word.
SLICE_BYTES = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive texts of about BLOCK_BYTES together."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def boundaries(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined, the words' starts and ends in that, and for each text its first word (one more at the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edges[0::2], edges[1::2]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return data, starts, ends, np.searchsorted(starts, begin)


def finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers from 0 on, and their inverses modulo 2^64."""
    both = []
    for factor in (_BASE, _INVERSE):
        line = np.full(n, factor, np.uint64)
        line[:1] = 1
        both.append(np.cumprod(line))
    return both[0], both[1]


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of every word the sum of its bytes' values times powers of the base: differences of a running sum, brought back to position 0."""
    powers, inverses = _powers(2 * SLICE_BYTES)
    n = len(data)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[data] * powers[:n])])
    return (running[ends] - running[starts]) * inverses[starts]


def _long_word(data: np.ndarray) -> np.uint64:
    total, factor = 0, 1
    for a in range(0, len(data), SLICE_BYTES):
        part = data[a : a + SLICE_BYTES]
        total += int(_polynomials(part, np.array([0]), np.array([len(part)]))[0]) * factor
        factor = factor * pow(_BASE, SLICE_BYTES, 2**64) % 2**64
    return np.uint64(total % 2**64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, a slice of the bytes at a time."""
    own = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    long_ = lengths > SLICE_BYTES
    for i in np.flatnonzero(long_).tolist():
        own[i] = _long_word(data[starts[i] : ends[i]])
    short = np.flatnonzero(~long_)
    piece = starts[short] // SLICE_BYTES
    for some in np.split(short, np.flatnonzero(np.diff(piece)) + 1):
        if len(some):
            first = starts[some[0]]
            own[some] = _polynomials(data[first : ends[some[-1]]], starts[some] - first, ends[some] - first)
    return finish(own + lengths.astype(np.uint64))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order matters: combine(a, b) and combine(b, a) differ."""
    return finish(left * np.uint64(_BASE) + right)


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of so many consecutive words (across texts too; the caller knows which are within one).

    Differences of a running polynomial over the words, brought back to position 0.
    """
    powers, inverses = _powers(2 * SLICE_BYTES)
    found = []
    step = len(powers) - length + 1
    for a in range(0, len(words) - length + 1, step):
        part = words[a : a + step + length - 1]
        n = len(part) - length + 1
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers[: len(part)])])
        found.append(finish((running[length : length + n] - running[:n]) * inverses[:n]))
    return np.concatenate([np.zeros(0, np.uint64), *found])


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed differences, byte plane by byte plane."""
    steps = np.diff(values, prepend=np.zeros(1, np.uint64))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_plain(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def unpack_plain(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def split_ranges(values: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of the pieces of sorted values that fall in equal ranges of the 64-bit space."""
    cuts = np.searchsorted(values, np.array([-(-(k << 64) // ranges) for k in range(1, ranges)], np.uint64))
    edges = [0, *cuts.tolist(), len(values)]
    return [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
