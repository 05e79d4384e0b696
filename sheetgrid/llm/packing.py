"""Packing documents into fixed windows by non-negative least squares.

* Each text becomes ids of a public tokenizer plus an end id; whole windows of a document are
  sequences of their own, its tail (1 to window - 1 ids) is left to combine.
* Tail lengths are counted; that histogram, at most `window` records, is all that the
  driver sees. Shallow combinations of two to four lengths that fill a window exactly are
  enumerated, and non-negative least squares gives how often to use each so that the counts
  are met. Repeats are rounded down to what the counts allow, and the lengths left over are
  packed greedily, largest first, whole patterns at a time.
* A tail's rank among those of its length says which pattern, repeat and place it gets.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgrid.llm.common import plain, running, stored

WINDOW = 1024
END_ID = 0


#: How a byte-level BPE of the `tokenizers` library cuts a text before it merges; a fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in a row that only the library itself takes.
_BLANKS = 10_000


class Encoder:
    """Ids of texts by a vocabulary of the `tokenizers` library, as little-endian 32-bit bytes.

    A plain byte-level BPE whose merges come in the order of their ids is the same as its ranks, which
    `tiktoken` merges several times as fast. Texts with an added token or very long white
    space, and all texts of any other vocabulary, go to the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"] for t in content["added_tokens"]]
        self.blank = re.compile(r"\s{%d}" % _BLANKS).search
        ranks = self._ranks(content)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ranks(self, content: dict) -> dict[bytes, int] | None:
        """Tokens as bytes with their ids, if ids say in which order pairs merge."""
        model, cut = content["model"], content["pre_tokenizer"] or {}
        whole = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items() <= cut.items()
        if model["type"] != "BPE" or content["normalizer"] or not whole or model.get("dropout") or model.get("ignore_merges"):
            return None
        vocabulary = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        ids = [vocabulary["".join(p)] for p in pairs]
        if any(a >= b for a, b in zip(ids, ids[1:])) or len(vocabulary.keys() - set(self.added)) != len(ids) + 256:
            return None
        # Bytes stand as themselves where Latin-1 prints them, the others as letters from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in self.added}

    def encode(self, texts: list[str]) -> list[bytes]:
        slow = [i for i, t in enumerate(texts) if not self._taken(t)]
        found = dict(zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)))
        out = []
        for i, text in enumerate(texts):
            ids = found[i].ids if i in found else self.fast.encode_to_numpy(text, disallowed_special=())
            out.append(np.asarray(ids, dtype="<u4").tobytes())
        return out

    def _taken(self, text: str) -> bool:
        if self.fast is None or any(a in text for a in self.added):
            return False
        return len(text) < _BLANKS or not self.blank(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokens(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc_tokens, crcs): checksums of each whole window and of the tail."""
    end = np.array([end_id], dtype="<u4").tobytes()
    size = 4 * window
    for batch in batches:
        ids = encoder(path)
        for at, texts in _by_size(batch.column("text")):
            lengths, crcs = [], []
            for data in ids.encode(texts):
                data += end
                lengths.append(len(data) // 4)
                crcs.append([zlib.crc32(data[i : i + size]) for i in range(0, len(data), size)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(at, len(texts)),
                    pa.array(lengths, pa.int64()),
                    pa.array(crcs, pa.list_(pa.int64())),
                ],
                ["doc_id", "doc_tokens", "crcs"],
            )


def _by_size(column: pa.Array, chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about a million characters together, or one longer text."""
    at, texts, total = 0, [], 0
    for i, text in enumerate(column):
        text = text.as_py() or ""
        if texts and total + len(text) > chars:
            yield at, texts
            at, texts, total = i, [], 0
        texts.append(text)
        total += len(text)
    if texts:
        yield at, texts


def combinations(window: int) -> np.ndarray:
    """(n, 4) lengths that add up to `window`, 0 for none: pairs, and three or four with repeats."""
    half = [(a, window - a, 0, 0) for a in range(1, window // 2 + 1)]
    three = [(a, a, window - 2 * a, 0) for a in range(1, (window - 1) // 2 + 1)]
    four = [(a, a, a, window - 3 * a) for a in range(1, (window - 1) // 3 + 1)]
    return np.array(half + three + four, dtype=np.int64).reshape(-1, 4)


def solve_counts(counts: np.ndarray, combos: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Non-negative least squares: repeats x of each combination so that lengths used meet `counts`.

    Accelerated projected gradient on ||A x - counts||^2, x >= 0; A[l, p] is how often
    combination p has length l.
    """
    n = len(counts)
    use = np.zeros((n, len(combos)))
    for k in range(4):
        some = combos[:, k] > 0
        np.add.at(use, (combos[some, k], np.flatnonzero(some)), 1.0)
    step = 1.0 / np.linalg.norm(use, 2) ** 2
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (use.T @ (use @ y - counts)))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def fill(left: np.ndarray, room: int, taken: int) -> dict[int, int]:
    """{length: times} of the tails left that fill `room` best; one of length `taken` is spoken for.

    Reachable sums as bits; k equal tails are one item (1, 2, 4, ... and the rest).
    """
    mask, reach, items = (1 << room + 1) - 1, [1], []
    for length in np.flatnonzero(left[: room + 1])[::-1].tolist():
        free, bundle = min(int(left[length]) - (length == taken), room // length), 1
        while free > 0 and not reach[-1] >> room & 1:
            k = min(bundle, free)
            new = (reach[-1] | reach[-1] << length * k) & mask
            if new != reach[-1]:
                items.append((length, k))
                reach.append(new)
            free, bundle = free - k, bundle * 2
    at, used = reach[-1].bit_length() - 1, {}
    for (length, k), before in zip(reversed(items), reversed(reach[:-1])):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def plan_patterns(histogram: dict[int, int], window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern, repeats)]: pattern = [(length, times)], longest first; every tail used exactly once."""
    left = np.zeros(window, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    found = []
    combos = combinations(window)
    combos = combos[(left[combos] > 0).__or__(combos == 0).all(axis=1)]
    if len(combos):
        repeats = solve_counts(left.astype(float), combos)
        for p in np.argsort(-repeats, kind="stable"):
            lengths, times = np.unique(combos[p][combos[p] > 0], return_counts=True)
            n = min(int(np.floor(repeats[p] + 1e-9)), int((left[lengths] // times).min()))
            if n > 0:
                left[lengths] -= n * times
                found.append((list(zip(lengths.tolist()[::-1], times.tolist()[::-1])), n))
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        pattern = {first: 1}
        for length, times in fill(left, window - first, first).items():
            pattern[length] = pattern.get(length, 0) + times
        n = min(int(left[length]) // times for length, times in pattern.items())
        for length, times in pattern.items():
            left[length] -= n * times
        found.append((sorted(pattern.items(), reverse=True), n))
    return found


def _places(plan: list, window: int) -> dict[str, np.ndarray]:
    """Per stretch of ranks of a length: where its tails go. Sorted by (length, first rank)."""
    used = [0] * window
    rows, sequence = [], 0
    for pattern, repeats in plan:
        offset = 0
        for length, times in pattern:
            rows.append((length, used[length], times, sequence, offset))
            used[length] += times * repeats
            offset += times * length
        sequence += repeats
    rows.sort()
    names = ("length", "first", "times", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], dtype=np.int64) for i, n in enumerate(names)} | {"n": sequence}


def _place(batches: Iterator[pa.RecordBatch], places: dict, window: int) -> Iterator[pa.RecordBatch]:
    starts = places["length"].astype(object) * (1 << 50) + places["first"] if len(places["length"]) else None
    keys = np.array(starts, dtype=np.int64) if starts is not None else None
    for batch in batches:
        tail, rank = batch.column("tail").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(tail), np.int64), np.zeros(len(tail), np.int64)
        some = tail > 0
        if some.any():
            at = np.searchsorted(keys, tail[some] * (1 << 50) + rank[some], side="right") - 1
            nth, slot = np.divmod(rank[some] - places["first"][at], places["times"][at])
            sequence[some] = places["sequence"][at] + nth
            offset[some] = places["offset"][at] + slot * tail[some]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(n) for n in ("doc_id", "doc_tokens", "crcs", "tail", "whole")],
                pa.array(sequence),
                pa.array(offset),
            ],
            ["doc_id", "doc_tokens", "crcs", "tail", "whole", "sequence_id", "offset"],
        )


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.

    Null and empty texts are the end id alone. Every row is a document, also one that repeats
    a doc_id or has none. Any other column of `documents` is ignored. `tokenizer` is the path
    of a vocabulary file of the `tokenizers` library; it exists on every executor.
    """
    source = plain(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    read = stored(
        source.mapInArrow(
            lambda b: _tokens(b, tokenizer, window, end_id), "doc_id long, doc_tokens long, crcs array<long>"
        ).withColumn("tail", F.col("doc_tokens") % window)
    )
    counts = {r["tail"]: r["n"] for r in read.groupBy("tail").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    counts.pop(0, None)
    places = _places(plan_patterns(counts, window), window)
    spread = F.xxhash64("doc_id", "doc_tokens", "crcs")
    order = [F.col("doc_id"), F.col("doc_tokens"), F.col("crcs")]
    whole = F.floor(F.col("doc_tokens") / window)
    numbered = running(read, [], whole, order, spread, rows, "whole")
    numbered = running(numbered, ["tail"], F.lit(1), order, spread, rows, "rank")
    placed = numbered.mapInArrow(
        lambda b: _place(b, places, window),
        "doc_id long, doc_tokens long, crcs array<long>, tail long, whole long, sequence_id long, offset long",
    )
    piece = placed.select("*", F.posexplode("crcs").alias("nth", "ids_crc32"))
    full = F.col("nth") < F.floor(F.col("doc_tokens") / window)
    return piece.select(
        "doc_id",
        (F.col("nth") * window).cast("long").alias("start"),
        F.when(full, window).otherwise(F.col("tail")).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(full, places["n"] + F.col("whole") + F.col("nth")).otherwise(F.col("sequence_id")).cast("long").alias("sequence_id"),
        F.when(full, 0).otherwise(F.col("offset")).cast("long").alias("offset"),
    )
