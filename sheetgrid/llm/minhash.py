"""MinHash near-dedup: one-permutation sketches, banded buckets, star candidates, exact links.

* A text's words, A-Z lower-cased, give its set of distinct 5-word shingles. Texts with equal
  sets are one class, represented by its smallest id; only classes go on.
* One-permutation hashing: the upper bits of a shingle's hash name one of 128 bins, the
  smallest hash in each bin is kept. An empty bin takes the value of a bin found by hashing
  (bin, attempt) until it meets a filled one (optimal densification).
* 32 bands of 4 bins are bucket keys. A pair of similarity 0.75 misses all buckets with
  probability (1 - 0.75**4)**32, about 5e-6.
* Candidates are stars: in a bucket each member is compared with one centre only, so
  a bucket of m classes gives m - 1 pairs. Buckets whose members are not all connected
  afterwards get another centre, once. Sets too unequal in size to be linked make no pair.
* What is still open then is compared exactly: in each bucket every member outside the largest
  component with all members, in salted blocks. So each pair that shares a bucket is tested or
  already connected. Where the buckets would take more comparisons than all pairs of their members,
  all those pairs are compared.
* Every candidate is confirmed on the full shingle sets. Texts are dealt by (centre, salt) with
  at most about 256 members each and streamed past the centre's set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetgrid.llm import rolling
from sheetgrid.llm.common import components, forget, plain, stored
from sheetgrid.llm.embeddings import Forest

WORDS = 5
PERCENT = 75
BANDS = 32
ROWS = 4
PER_SALT = 256
STAR_ROUNDS = 2
BLOCK = 1 << 19  # shingles
_EMPTY = np.iinfo(np.uint64).max


def shingle_sets(chunk: rolling.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of text i, ascending, are hashes[bounds[i]:bounds[i+1]].

    A text of fewer words has its whole sequence as the only shingle; none without words.
    """
    hashes, at = rolling.windows(chunk, size)
    of = np.searchsorted(at, chunk.bounds)
    sets = []
    for i, n in enumerate(np.diff(chunk.bounds)):
        if n >= size or n == 0:
            sets.append(np.unique(hashes[of[i] : of[i + 1]]))
        else:
            begin = chunk.bounds[i]
            powers, _ = rolling._WORD_POWERS.get(size)
            sets.append(rolling.mix((chunk.words[begin : begin + n] * powers[:n]).sum(keepdims=True)))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), bounds


def one_permutation(hashes: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """(texts, bins) sketch of non-empty sets; `bins` is a power of two."""
    n = len(bounds) - 1
    shift = np.uint64(64 - (bins.bit_length() - 1))
    cell = np.repeat(np.arange(n), np.diff(bounds)) * bins + (hashes >> shift).astype(np.int64)
    first = np.ones(len(cell), dtype=bool)  # sets are ascending, so a bin's first is its smallest
    first[1:] = cell[1:] != cell[:-1]
    sketch = np.full(n * bins, _EMPTY)
    sketch[cell[first]] = hashes[first]
    filled = sketch != _EMPTY
    rows, empty = np.divmod(np.flatnonzero(~filled), bins)
    some = filled.reshape(n, bins).any(axis=1)
    rows, empty = rows[some[rows]], empty[some[rows]]
    attempt = 0
    while len(rows):
        attempt += 1
        key = empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)
        donor = rows * bins + (rolling.mix(key) % np.uint64(bins)).astype(np.int64)
        hit = filled[donor]
        sketch[rows[hit] * bins + empty[hit]] = sketch[donor[hit]]
        rows, empty = rows[~hit], empty[~hit]
    return sketch.reshape(n, bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) bucket keys; a key tells its band, too."""
    powers, _ = rolling._WORD_POWERS.get(rows + 1)
    parts = sketch.reshape(len(sketch), bands, rows) * powers[1 : rows + 1]
    return rolling.mix(rolling.mix(parts.sum(axis=2)) + np.arange(bands, dtype=np.uint64))


def _sketches(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in rolling.chunks(batch.column("text"), lower=True):
            hashes, bounds = shingle_sets(c, size)
            counts = np.diff(bounds)
            keys = band_keys(one_permutation(hashes, bounds, bands * rows), bands, rows).view(np.int64)
            names = [
                hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds, bounds[1:])
            ]
            flat = pa.array(keys.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(c.first, c.last - c.first),
                    batch.column("text_hash").slice(c.first, c.last - c.first),
                    pa.array(names, pa.binary()),
                    pa.array(counts),
                    lists,
                ],
                ["doc_id", "text_hash", "set_key", "n_shingles", "bands"],
            )


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (a, salt, b), a centre's text (b null) before its members': the links."""
    key, centre = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, salt, b = (batch.column(n).to_pylist() for n in ("a", "salt", "b"))
        links: tuple[list, list] = ([], [])
        for c in rolling.chunks(batch.column("text"), lower=True):
            hashes, bounds = shingle_sets(c, size)
            for i in range(c.last - c.first):
                row, own = c.first + i, hashes[bounds[i] : bounds[i + 1]]
                if b[row] is None:
                    key, centre = (a[row], salt[row]), own
                elif key == (a[row], salt[row]) and len(own) and len(centre):
                    at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                    both = int((centre[at] == own).sum())
                    if 100 * both >= percent * (len(centre) + len(own) - both):
                        links[0].append(a[row])
                        links[1].append(b[row])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; `texts` has one row per id."""
    crowds = stored(pairs.groupBy("a").agg((F.floor(F.count("*") / PER_SALT) + 1).cast("int").alias("salts")))
    centres = crowds.join(texts, F.col("a") == F.col("doc_id")).select(
        "a",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(None).cast("long").alias("b"),
        "text",
    )
    members = (
        pairs.join(crowds, "a")
        .select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
        .join(texts, F.col("b") == F.col("doc_id"))
        .select("a", "salt", "b", "text")
    )
    return (
        centres.unionByName(members)
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        .mapInArrow(lambda rows: _confirm(rows, size, percent), "a long, b long")
    )


class _Block:
    """Shingle sets, indexed for exact intersections with others: a matrix of the shingles that many of
    the sets hold, lists of owners for the rest."""

    def __init__(self, sets: list[np.ndarray], labels: list[int]):
        self.labels, self.sizes = np.array(labels), np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.names, self.first, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        many = self.counts * 16 > len(sets)
        self.column = np.where(many, np.cumsum(many) - 1, -1)
        self.matrix = np.zeros((int(many.sum()), len(sets)), dtype=np.float32)
        of = np.repeat(self.column, self.counts)
        self.matrix[of[of >= 0], self.owners[of >= 0]] = 1

    def overlaps(self, sets: list[np.ndarray]) -> np.ndarray:
        """[set, member]: sizes of the intersections."""
        held = np.zeros((len(sets), len(self.matrix)), dtype=np.float32)
        rest = np.zeros((len(sets), len(self.sizes)), dtype=np.int64)
        for i, own in enumerate(sets):
            at = np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)
            at = at[self.names[at] == own]
            column = self.column[at]
            held[i, column[column >= 0]] = 1
            at = at[column < 0]
            n = self.counts[at]
            if len(at):
                places = np.arange(n.sum()) + np.repeat(self.first[at] - np.cumsum(n) + n, n)
                rest[i] = np.bincount(self.owners[places], minlength=len(self.sizes))
        return rest + (held @ self.matrix).astype(np.int64)


def _across(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (bucket, block, query): links between the components of a block's members, and
    of members and queries. Queries stream past the block."""
    key, block, forest = None, None, Forest()
    sets: list[np.ndarray] = []
    labels: list[int] = []

    def meet(others: list[np.ndarray], theirs: list[int], links: tuple[list, list]) -> None:
        step = max(1, min(64, (1 << 22) // max(len(block.matrix), len(block.sizes), 1)))
        for at in range(0, len(others), step):
            part, own = others[at : at + step], np.array(theirs[at : at + step])
            both = block.overlaps(part)
            union = np.array([len(x) for x in part])[:, None] + block.sizes[None, :] - both
            near = (100 * both >= percent * union) & (own[:, None] != block.labels[None, :])
            for i in np.flatnonzero(near.any(axis=1)):
                for other in np.unique(block.labels[near[i]]).tolist():
                    if forest.join(int(own[i]), other):
                        links[0].append(int(own[i]))
                        links[1].append(other)

    def close(links: tuple[list, list]) -> None:
        """The block is whole: its members meet each other."""
        nonlocal block, sets, labels
        if block is None and sets:
            block = _Block(sets, labels)
            meet(sets, labels, links)
            sets, labels = [], []

    for batch in batches:
        place = list(zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()))
        query, component = batch.column("query").to_pylist(), batch.column("component").to_pylist()
        links: tuple[list, list] = ([], [])
        for c in rolling.chunks(batch.column("text"), lower=True):
            hashes, bounds = shingle_sets(c, size)
            waiting: tuple[list, list] = ([], [])
            for i in range(c.last - c.first):
                row, own = c.first + i, hashes[bounds[i] : bounds[i + 1]]
                if place[row] != key:
                    if waiting[0]:
                        meet(*waiting, links)
                        waiting = ([], [])
                    close(links)
                    key, block, forest = place[row], None, Forest()
                if query[row]:
                    close(links)
                    if block is not None:
                        waiting[0].append(own)
                        waiting[1].append(component[row])
                else:
                    sets.append(own.copy())
                    labels.append(component[row])
            if waiting[0]:
                meet(*waiting, links)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])
    links = ([], [])
    close(links)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be linked: the smaller is the most that they can share."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def rest(at: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of components whose members share a bucket: all of them. `at` has bucket, doc_id,
    n_shingles and component; a bucket of two is taken as compared."""

    def opened(rows: DataFrame) -> DataFrame:
        return stored(
            rows.groupBy("bucket", "component")
            .agg(
                F.count("*").alias("k"),
                F.sum("n_shingles").alias("s"),
                F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("h"),
            )
            .groupBy("bucket")
            .agg(
                F.sum("k").alias("n"),
                F.sum("s").alias("s"),
                F.sum("h").alias("h"),
                F.max(F.struct("k", "component", "s")).alias("main"),
            )
            .where("main.k < n AND n > 2")
            # Buckets of the same members count once.
            .groupBy("n", "h")
            .agg(F.min(F.struct("bucket", "main", "s")).alias("x"))
            .select(
                "x.bucket",
                F.col("x.main.component").alias("main"),
                (F.floor((F.col("x.s") - F.col("x.main.s")) / BLOCK) + 1).cast("int").alias("blocks"),
                ((F.col("n") - F.col("x.main.k")) * F.col("n")).cast("double").alias("pairs"),
            )
        )

    open_ = opened(at)
    pairs = open_.agg(F.sum("pairs")).first()[0] or 0
    members = at.join(open_.select("bucket"), "bucket").select("doc_id", "n_shingles", "component")
    if pairs > float(members.select("doc_id").distinct().count()) ** 2:
        at = stored(members.dropDuplicates(["doc_id"]).withColumn("bucket", F.lit(0).cast("long")))
        open_ = opened(at)
    salt = F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")
    main = F.col("component") == F.col("main")
    return (
        at.join(open_, "bucket")
        .select(
            "bucket",
            "doc_id",
            "component",
            F.when(main, -1).otherwise(salt).alias("home"),
            # A member outside the largest component is in a block, and meets the blocks before it.
            F.explode(F.sequence(F.lit(0), F.when(main, F.col("blocks") - 1).otherwise(salt))).alias("block"),
        )
        .withColumn("query", F.col("block") != F.col("home"))
        .join(texts, "doc_id")
        .select("bucket", "block", "query", "component", "text")
        .repartition("bucket", "block")
        .sortWithinPartitions("bucket", "block", "query")
        .mapInArrow(lambda rows: _across(rows, size, percent), "a long, b long")
    )


def near_duplicates(
    documents: DataFrame, size: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Linked: 100 * |intersection| >= percent * |union| of the shingle sets. component_id is the
    smallest doc_id reachable over links; kept = (doc_id = component_id).

    Null or empty text, or white space alone: no shingles, linked with nothing. A null doc_id:
    component_id null, kept, linked with nothing. Rows that repeat a doc_id are one node.
    Any other column of `documents` is ignored. bands * rows is a power of two.
    """
    source = plain(documents, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")
    )
    read = stored(
        source.mapInArrow(
            lambda b: _sketches(b, size, bands, rows),
            "doc_id long, text_hash long, set_key binary, n_shingles long, bands array<long>",
        )
    )
    classes = stored(
        read.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        .select("set_key", "first.*", "n_shingles", "bands")
    )
    inside = classes.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    centres = stored(
        inside.groupBy("bucket")
        .agg(F.min(F.struct("doc_id", "n_shingles")).alias("c"), F.max("doc_id").alias("high"))
        .where("c.doc_id < high")
        .select("bucket", F.col("c.doc_id").alias("a"), F.col("c.n_shingles").alias("a_shingles"))
    )
    members = stored(inside.join(centres.select("bucket"), "bucket"))
    # Of texts that share a doc_id the one of the smallest hash stands for it. Texts move once: joined by
    # doc_id alone, which the removal of repeated rows is content with.
    met = (
        members.select("doc_id")
        .distinct()
        .join(classes.groupBy("doc_id").agg(F.min("text_hash").alias("held")), "doc_id")
    )
    texts = stored(
        source.join(met, "doc_id").where("text_hash ^ held = 0").select("doc_id", "text").dropDuplicates(["doc_id"])
    )
    pairs = stored(
        members.join(centres, "bucket")
        .where("a <> doc_id")
        .where(may_link("a_shingles", "n_shingles", percent))
        .select("a", F.col("doc_id").alias("b"))
        .distinct()
    )
    forget(centres)
    links = stored(confirm(pairs, texts, size, percent))
    linked = stored(components(links))
    groups = stored(
        members.select("doc_id")
        .distinct()
        .join(linked, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    )
    forget(links)
    forget(linked)
    tested = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))

    def united(groups: DataFrame, more: DataFrame) -> DataFrame:
        """The groups after links of components."""
        merged = stored(components(more).withColumnRenamed("component", "into"))
        after = stored(
            groups.join(merged, F.col("component") == F.col("node"), "left").select(
                "doc_id", F.coalesce("into", "component").alias("component")
            )
        )
        forget(merged)
        forget(groups)
        return after

    whole = False
    for turn in range(1, STAR_ROUNDS):
        at = members.join(groups, "doc_id")
        chosen = F.min_by(
            F.struct(F.col("doc_id").alias("a"), F.col("n_shingles").alias("a_shingles"), F.col("component").alias("own")),
            F.xxhash64("doc_id", "bucket", F.lit(turn)),
        )
        open_ = stored(
            at.groupBy("bucket")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"), chosen.alias("c"))
            .where("low < high")
            .select("bucket", "c.*")
        )
        whole = open_.isEmpty()
        if whole:
            break
        tries = stored(
            at.join(open_, "bucket")
            .where("component <> own")
            .where(may_link("a_shingles", "n_shingles", percent))
            .select(
                "a",
                F.col("doc_id").alias("b"),
                "own",
                "component",
                F.least("a", "doc_id").alias("lo"),
                F.greatest("a", "doc_id").alias("hi"),
            )
            .distinct()
            .join(tested, ["lo", "hi"], "left_anti")
        )
        more = stored(confirm(tries.select("a", "b"), texts, size, percent))
        # Each of these links joins two components: only those are looked at.
        groups = united(groups, tries.join(more, ["a", "b"]).select(F.col("own").alias("a"), F.col("component").alias("b")))
        for table in (open_, tries, more):
            forget(table)
    forget(pairs)
    if not whole:
        at = stored(members.join(groups, "doc_id"))
        groups = united(groups, rest(at, texts, size, percent))
        forget(at)
    forget(members)
    forget(texts)
    known = stored(
        classes.join(groups, "doc_id", "left").select(
            "set_key", F.coalesce("component", "doc_id").alias("component_id")
        )
    )
    return (
        read.select("doc_id", "set_key", "n_shingles")
        .join(known, "set_key", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)).alias("kept"))
    )
