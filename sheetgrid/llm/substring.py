"""Substring dedup: words under a window of 50 that an earlier document has, too, go.

Every window of `size` consecutive words gets a Rabin-Karp hash (``rolling.windows``), and
windows are counted in Spark by that hash. What travels is bounded beforehand, exactly:

* Texts with the same words are one text; of them only the smallest id counts windows.
* Each window's *anchor* is the smallest hash among its inner windows of 8 words. Equal
  windows have equal anchors, and neighbours mostly share theirs, so there are about
  a twentieth as many anchors as windows. A window whose anchor occurs in one document
  only has count one, and is not sent.
* Within a chunk of documents the smallest holder of each window hash stands for the
  chunk, so a passage in a third of all rows arrives once per chunk.

Windows of a document that a smaller id holds merge into maximal removal intervals.

Hashes have 64 bits: among N windows with shared anchors about N*N/2**65 pairs collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetgrid.llm import rolling
from sheetgrid.llm.common import SPACES, plain, stored

SIZE = 50
INNER = 8


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i; past the end counts as the largest number."""
    m, reach = x.copy(), 1
    while reach < width:
        step = min(reach, width - reach)
        m[:-step] = np.minimum(m[:-step], m[step:])
        reach += step
    return m


def window_anchors(chunk: rolling.Chunk, size: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window hash, anchor, first word) of every window of a chunk."""
    hashes, at = rolling.windows(chunk, size)
    values, positions = rolling.windows(chunk, inner)
    # An inner window that spans two texts lies in no window of a single text.
    full = np.full(len(chunk.words), np.iinfo(np.uint64).max)
    full[positions] = values
    return hashes, sliding_min(full, size - inner + 1)[at] if len(at) else hashes, at


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _read(batches: Iterator[pa.RecordBatch], size: int, inner: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for c in rolling.chunks(batch.column("text")):
            _, anchors, at = window_anchors(c, size, inner)
            of = np.searchsorted(at, c.bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(c.first, c.last - c.first),
                    batch.column("text_hash").slice(c.first, c.last - c.first),
                    pa.array([_digest(c.text_words(i)) for i in range(c.last - c.first)]),
                    pa.array(np.diff(c.bounds)),
                    pa.array(
                        [np.unique(anchors[a:b]).view(np.int64) for a, b in zip(of, of[1:])],
                        pa.list_(pa.int64()),
                    ),
                ],
                ["doc_id", "text_hash", "words_sha", "n_words", "anchors"],
            )


def _mark(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first holder of each hash, and of the holders after it.

    Owners are ascending numbers; a further window of the first holder itself is neither.
    """
    order = np.lexsort((owner, hashes))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    later = o != o[np.flatnonzero(new)][group] if len(h) else new
    return order[new], order[later]


def _windows(batches: Iterator[pa.RecordBatch], size: int, inner: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk: the first holder of every window hash with a shared anchor (later = false)
    and the other holders (later = true)."""
    for batch in batches:
        wanted, ids = batch.column("shared"), batch.column("doc_id").to_numpy()
        for c in rolling.chunks(batch.column("text"), chunk_bytes=8 * rolling.CHUNK_BYTES):
            hashes, anchors, at = window_anchors(c, size, inner)
            if not len(hashes):
                continue
            row = c.row_of_word()[at]
            mine = wanted.slice(c.first, c.last - c.first)
            flat = mine.flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(len(mine)), mine.value_lengths().to_numpy())
            # An anchor and its document as one number: equal numbers are confirmed by a second.
            salt = rolling.mix(np.arange(len(mine), dtype=np.uint64) + np.uint64(1))
            held = np.isin(anchors ^ salt[row], flat ^ salt[of])
            hashes, row = hashes[held], row[held]
            doc = ids[c.first : c.last][row]
            first, later = _mark(hashes, doc)
            # The same window twice in a later document is one verdict.
            pairs = np.unique(np.stack([hashes[later], doc[later].astype(np.uint64)]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([hashes[first], pairs[0]]).view(np.int64)),
                    pa.array(np.concatenate([doc[first], pairs[1].astype(np.int64)])),
                    pa.array(np.arange(len(first) + pairs.shape[1]) >= len(first)),
                ],
                ["hash", "doc_id", "later"],
            )


def removal_intervals(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal intervals [begin, end) covered by windows that start at the given, ascending words."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > size) + 1
    return [(int(part[0]), int(part[-1]) + size) for part in np.split(starts, cut)]


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, removed, digests = [], [], []
        repeated = batch.column("repeated")
        for c in rolling.chunks(batch.column("text")):
            hashes, at = rolling.windows(c, size)
            of = np.searchsorted(at, c.bounds)
            for i in range(c.last - c.first):
                bad = repeated[c.first + i].values.to_numpy().view(np.uint64)
                own = slice(of[i], of[i + 1])
                found = removal_intervals(at[own][np.isin(hashes[own], bad)] - c.bounds[i], size)
                words = c.text_words(i)
                kept = without(words, found)
                spans.append([{"begin": a, "end": b} for a, b in found])
                removed.append(len(words) - len(kept))
                digests.append(_digest(kept))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("words_sha"),
                pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                pa.array(removed, pa.int64()),
                pa.array(digests, pa.string()),
            ],
            ["words_sha", "intervals", "n_removed", "kept_sha256"],
        )


def without(words: list, intervals: list[tuple[int, int]]) -> list:
    kept, done = [], 0
    for begin, end in intervals:
        kept += words[done:begin]
        done = end
    return kept + words[done:]


def remove_repeats(documents: DataFrame, size: int = SIZE, inner: int = INNER) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, intervals.

    A word goes if a window of `size` words around it also starts in a document with
    a smaller doc_id. `intervals` are the maximal runs [begin, end) of words removed;
    kept_sha256 is of the kept words joined by one space.

    Null or empty text: no words, nothing removed. A null doc_id is neither smaller nor
    larger than another: nothing is removed, and nothing because of it. Rows that repeat a
    doc_id are judged one by one, and never because of each other. Any other column
    of `documents` is ignored.
    """
    inner = min(inner, size)
    source = plain(documents, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")
    )
    read = stored(
        source.mapInArrow(
            lambda b: _read(b, size, inner),
            "doc_id long, text_hash long, words_sha string, n_words long, anchors array<long>",
        )
    )
    # Documents with the same words: the smallest id stands for all of them.
    firsts = stored(
        read.where((F.col("n_words") >= size) & F.col("doc_id").isNotNull())
        .groupBy("words_sha")
        .agg(
            F.min(F.struct("doc_id", "text_hash")).alias("first"),
            F.first("n_words").alias("n_words"),
            F.first("anchors").alias("anchors"),
        )
        .select("words_sha", "first.*", "n_words", "anchors")
    )
    held = firsts.select("doc_id", "text_hash", "words_sha", F.explode("anchors").alias("anchor"))
    shared = stored(
        held.groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
        .select("anchor")
    )
    wanted = (
        held.join(shared, "anchor")
        .groupBy("doc_id", "text_hash", "words_sha")
        .agg(F.collect_list("anchor").alias("shared"))
    )
    # The texts with a shared anchor: the only ones that move.
    candidates = stored(
        source.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    )
    found = candidates.mapInArrow(
        lambda b: _windows(b, size, inner), "hash long, doc_id long, later boolean"
    )
    first = found.where("not later").select("hash", "doc_id")
    smallest = Window.partitionBy("hash")
    after = first.withColumn("low", F.min("doc_id").over(smallest)).where("doc_id > low")
    verdicts = (
        after.select("doc_id", "hash")
        .unionByName(found.where("later").select("doc_id", "hash"))
        .groupBy("doc_id")
        .agg(F.collect_set("hash").alias("repeated"))
    )
    cut = candidates.join(verdicts, "doc_id").mapInArrow(
        lambda b: _cut(b, size),
        "words_sha string, intervals array<struct<begin:long,end:long>>,"
        " n_removed long, kept_sha256 string",
    )
    known = stored(
        firsts.select("words_sha", F.col("doc_id").alias("first_id")).join(cut, "words_sha", "left")
    )
    nothing = F.array().cast("array<struct<begin:long,end:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end")))
    copy = F.col("doc_id") > F.col("first_id")
    return (
        read.drop("anchors", "text_hash")
        .join(known, "words_sha", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.sha2(F.lit(""), 256))
            .when(F.col("doc_id").isNotNull(), F.coalesce("kept_sha256", "words_sha"))
            .otherwise(F.col("words_sha"))
            .alias("kept_sha256"),
            F.when(copy, whole)
            .when(F.col("doc_id").isNotNull(), F.coalesce("intervals", nothing))
            .otherwise(nothing)
            .alias("intervals"),
        )
    )


def cut_texts(documents: DataFrame, removed: DataFrame) -> DataFrame:
    """(doc_id, text): the words that `remove_repeats` keeps, joined by one space.

    For tables whose doc_id is unique; a null text stays null.
    """
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    outside = lambda i: ~F.exists("intervals", lambda r: (i >= r["begin"]) & (i < r["end"]))
    return (
        plain(documents, "doc_id", "text")
        .join(removed.select("doc_id", "intervals"), "doc_id")
        .select("doc_id", F.array_join(F.filter(words, lambda w, i: outside(i)), " ").alias("text"))
    )
