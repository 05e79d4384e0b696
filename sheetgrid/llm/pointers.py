"""Sorting pointers to words instead of words, over the buffers of Arrow string columns.

A word is a slice of a byte buffer. Pointers to word starts are sorted by multikey quicksort: a
stretch of pointers is split in three by one super-character (eight bytes at the present depth,
zeros after the word's end) around a pivot; the equal part goes on eight bytes deeper, unless
the super-character ends the word. Short stretches are sorted depth by depth at once. Slices that
end up in one run are equal byte for byte; no hash stands for a word.

Words hold no zero byte, so the zeros after a word's end sort before every longer word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are sorted together, one text at least.
SHARD_BYTES = 8 << 20
#: Pointers below which a stretch is no longer split.
_SHORT = 1 << 16
_KEEP = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(9)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shards(texts: pa.Array, limit: int = SHARD_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets of the rows in them); null texts are empty.

    A-Z come lower-cased.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        own = offsets[first : last + 1] - offsets[first]
        yield first, last, _LOWER[data[offsets[first] : offsets[last]]], own
        first = last


def slices(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of `inside` bytes within one text."""
    if not len(inside):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True  # texts begin and end here
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, np.flatnonzero(ends) + 1, rows


class Words:
    """Slices of a buffer, read eight bytes at a time."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eights = np.ndarray((len(data) + 1,), dtype=">u8", buffer=padded, strides=(1,))

    def at(self, which: np.ndarray, depth: int) -> np.ndarray:
        """The super-character of each word at a depth."""
        start = self.starts[which] + depth
        rest = self.ends[which] - start
        key = self.eights[np.minimum(start, len(self.data))].astype(np.uint64)
        return key & _KEEP[np.clip(rest, 0, 8)]

    def strings(self, which: np.ndarray) -> pa.Array:
        """The words as an Arrow array."""
        size = self.ends[which] - self.starts[which]
        offsets = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(offsets[-1]) + np.repeat(self.starts[which] - offsets[:-1], size)
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[place].tobytes())]
        return pa.Array.from_buffers(pa.large_string(), len(which), buffers).cast(pa.string())


def sort(words: Words, short: int = _SHORT) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the words in byte order, and whether a place begins a run of equal words.

    Equal words stay in the order of their pointers.
    """
    n = len(words.starts)
    order, first = np.arange(n), np.zeros(n, dtype=bool)
    todo = [(0, n, 0)] if n else []
    while todo:
        low, high, depth = todo.pop()
        own = order[low:high]
        key = words.at(own, depth)
        if high - low <= short:
            _finish(words, order, first, low, high, depth, key)
            continue
        sample = np.sort(key[:: max(1, len(key) // 15)])
        pivot = sample[len(sample) // 2]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        a, b = int(less.sum()), int(same.sum())
        order[low:high] = np.concatenate([own[less], own[same], own[more]])
        if pivot & np.uint64(0xFF):  # goes on after these eight bytes
            todo.append((low + a, low + a + b, depth + 8))
        else:
            first[low + a] = True
        todo += [part for part in ((low, low + a, depth), (low + a + b, high, depth)) if part[0] < part[1]]
    return order, first


def _finish(words: Words, order, first, low: int, high: int, depth: int, key: np.ndarray) -> None:
    """Sort a short stretch: by one super-character, then runs of equal, unended ones by the next."""
    by = np.argsort(key, kind="stable")
    own, key = order[low:high][by], key[by]
    new = np.ones(len(own), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    place = np.arange(len(own))
    while True:
        run = np.cumsum(new)[place]
        crowd = np.zeros(len(place), dtype=bool)
        if len(place) > 1:
            crowd[1:] = run[1:] == run[:-1]
            crowd[:-1] |= crowd[1:]
        go = crowd & ((key & np.uint64(0xFF)) != 0)
        place, run, depth = place[go], run[go], depth + 8
        if not len(place):
            break
        key = words.at(own[place], depth)
        by = np.lexsort((key, run))
        own[place], key = own[place][by], key[by]
        new[place[1:]] |= (key[1:] != key[:-1]) & (run[1:] == run[:-1])
    order[low:high] = own
    first[low:high] = new
