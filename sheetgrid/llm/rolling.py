"""Word and window hashes of whole texts, computed over Arrow string buffers.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. The bytes of a batch go through
a polynomial (Rabin-Karp) prefix sum modulo 2**64, so the hash of any word, and of
any window of words, is a difference of two sums: the work is a fixed number of
array operations per byte, whatever the window's length.

Texts are taken in chunks of about a megabyte (one text at least), which bounds
the memory of a task by its longest text. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_M64 = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit numbers from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer: the bits of a polynomial hash become usable as a uniform key."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base = base | 1
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, base & _M64, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = _splitmix(256, 0x5EED)
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BYTE_POWERS = Powers(0xD6E8FEB86659FD93)
_WORD_POWERS = Powers(0xA0761D6478BD642F)


@dataclass
class Chunk:
    """Consecutive texts of a batch.

    first, last: the rows [first, last) of the batch; data: their bytes; starts, ends:
    byte positions of each word; words: hash of each word; bounds: the words of
    text i are bounds[i]:bounds[i + 1]; offsets: its bytes likewise.
    """

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    bounds: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.bounds))

    def text_words(self, i: int) -> list[bytes]:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().split()


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(texts: pa.Array, lower: bool = False, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The words of all texts of a column, in chunks of whole texts."""
    if not len(texts):
        return
    offsets, data = _buffers(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        own = offsets[first : last + 1] - offsets[first]
        yield _chunk(first, last, data[offsets[first] : offsets[last]], own, lower)
        first = last


def _chunk(first: int, last: int, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Chunk:
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Chunk(first, last, data, offsets, none, none, none.astype(np.uint64), np.zeros(last - first + 1, np.int64))
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _BYTE_POWERS.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_BYTES_LOWER if lower else _BYTES)[data] * up[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    return Chunk(first, last, data, offsets, starts, ends, words, np.searchsorted(starts, offsets))


def windows(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every window of `size` consecutive words within one text.

    Positions count the words of the chunk; each window is named by its first word.
    """
    n = len(chunk.words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _WORD_POWERS.get(len(chunk.words) + 1)
    sums = np.zeros(len(chunk.words) + 1, dtype=np.uint64)
    np.cumsum(chunk.words * up[: len(chunk.words)], out=sums[1:])
    hashes = mix((sums[size:] - sums[:-size]) * down[:n])
    ends = np.repeat(chunk.bounds[1:], np.diff(chunk.bounds))
    whole = np.arange(n) + size <= ends[:n]
    return hashes[whole], np.flatnonzero(whole)
