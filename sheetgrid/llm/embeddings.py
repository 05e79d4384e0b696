"""Embedding near-dedup by sorted projection passes.

* Equal vectors are one class; the smallest id stands for it.
* Per pass a class gets a key of 62 sign bits of random projections. All classes are sorted
  by that key (one range shuffle for all passes), and each is compared by exact cosine with
  the WINDOW classes before it. The number of passes follows from the number of
  classes, so that a pair just at the threshold is missed by all passes with
  probability `miss` at most, at any size.
* Verified pairs of all passes are united to components. A task sends on only links that
  connect something new within its stretch, so thousands of near copies give a few links each.
* n_links is then counted exactly inside each component. Members within half the threshold
  angle of the component's first vector are linked to each other without comparison
  (angles obey the triangle inequality); the others are compared with blocks of members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgrid.llm.common import components, plain, stored

COSINE = 0.9
WINDOW = 128
BITS = 62
MISS = 0.01
BLOCK = 2048


def bucket_bits(n: int, window: int = WINDOW) -> int:
    """Leading bits that leave about `window` of n evenly spread classes."""
    return min(BITS, max(0, math.ceil(math.log2(max(n, 1) / window))))


def passes_needed(n: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has shared a bucket with probability 1 - miss.

    A bucket is the first `bucket_bits` bits; each agrees with probability 1 - angle / pi.
    """
    bits = bucket_bits(n, window)
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree))) if agree < 1 else 1


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, whatever their magnitude."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _units(column: pa.Array, dims: int, dtype: str) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)
    return unit_rows(flat.reshape(-1, dims))


def _normal(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """(vec_id, dims, vec): bytes of usable vectors, null of others. Negative zeros become zeros."""
    for batch in batches:
        out = []
        for item in batch.column("embedding"):
            vec = None
            if item.is_valid and len(item) and not item.values.null_count:
                x = item.values.to_numpy(zero_copy_only=False).astype(dtype) + np.zeros(1, dtype)
                vec = x.tobytes() if np.isfinite(x).all() and x.any() else None
            out.append(vec)
        size = np.dtype(dtype).itemsize
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id"),
                pa.array([len(v) // size if v else 0 for v in out], pa.int32()),
                pa.array(out, pa.binary()),
                pa.array([hashlib.blake2b(v, digest_size=16).digest() if v else None for v in out], pa.binary()),
            ],
            ["vec_id", "dims", "vec", "same"],
        )


def _keys(batches: Iterator[pa.RecordBatch], passes: int, dtype: str, seed: int, *carried: str) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            part = batch.take(pa.array(own))
            units = _units(part.column("vec"), int(d), dtype)
            for p in range(passes):
                if (p, d) not in planes:
                    planes[p, d] = np.random.default_rng([seed, p, int(d)]).standard_normal((int(d), BITS))
                keys = ((units @ planes[p, d]) > 0) @ weights
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), p, dtype=np.int32)),
                        pa.array(keys),
                        part.column("vec_id"),
                        part.column("dims"),
                        *[part.column(n) for n in carried],
                    ],
                    ["pass", "key", "vec_id", "dims", *carried],
                )


class Forest:
    """Union-find over a task's stretch of rows."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.parent.setdefault(x, x)
        while up != self.parent[up]:
            self.parent[x] = self.parent[up]
            x, up = up, self.parent[up]
        return up

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _neighbours(batches: Iterator[pa.RecordBatch], dtype: str, cosine: float, window: int) -> Iterator[pa.RecordBatch]:
    """Links between rows at most `window` apart in a sorted stretch, as far as they connect anew.

    The first and the last row of the task come as (dims, pass, key): their buckets may go on elsewhere.
    """
    stretch, ends = None, []
    for batch in batches:
        if len(batch):
            place = [batch.column(n) for n in ("dims", "pass", "key")]
            ends = [*ends[:1], tuple(x[len(batch) - 1].as_py() for x in place)]
            if len(ends) == 1:
                ends.insert(0, tuple(x[0].as_py() for x in place))
        group = batch.column("dims").to_numpy().astype(np.int64) << 32 | batch.column("pass").to_numpy()
        ids, vecs = batch.column("vec_id").to_numpy(), batch.column("vec")
        links: tuple[list, list] = ([], [])
        cuts = np.flatnonzero(np.diff(group)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(ids)]):
            if stretch != group[begin]:
                stretch, tail_ids, tail, forest = group[begin], np.zeros(0, np.int64), None, Forest()
            for at in range(begin, end, 512):
                to = min(end, at + 512)
                new = _units(vecs.slice(at, to - at), int(group[begin] >> 32), dtype)
                all_ = new if tail is None else np.concatenate([tail, new])
                all_ids = np.concatenate([tail_ids, ids[at:to]])
                before = len(all_) - len(new)
                near = new @ all_.T >= cosine
                gap = np.arange(before, len(all_))[:, None] - np.arange(len(all_))[None, :]
                near &= (gap > 0) & (gap <= window)
                for i in np.flatnonzero(near.any(axis=1)):
                    own = int(all_ids[before + i])
                    for other in all_ids[np.flatnonzero(near[i])].tolist():
                        if forest.join(own, other):
                            links[0].append(own)
                            links[1].append(other)
                tail, tail_ids = all_[-window:], all_ids[-window:]
        none = pa.nulls(len(links[0]), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(x, pa.int64()) for x in links], none.cast(pa.int32()), none.cast(pa.int32()), none],
            ["a", "b", "dims", "pass", "key"],
        )
    if ends:
        none, kinds = pa.nulls(2, pa.int64()), (pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, *[pa.array(x, k) for x, k in zip(zip(*ends), kinds)]], ["a", "b", "dims", "pass", "key"]
        )


def _across(batches: Iterator[pa.RecordBatch], dtype: str, cosine: float) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (dims, pass, bucket, block, query): links between the components of a block's
    members, and of members and queries. Queries stream past the block."""
    key = None
    for batch in batches:
        place = [batch.column(n).to_numpy() for n in ("dims", "pass", "bucket", "block")]
        query = batch.column("query").to_numpy(zero_copy_only=False)
        component, vecs = batch.column("component").to_numpy(), batch.column("vec")
        links: tuple[list, list] = ([], [])
        change = np.diff(query.astype(np.int8)) != 0
        for x in place:
            change |= np.diff(x) != 0
        cuts = np.flatnonzero(change) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(query)] if len(query) else []):
            own_key = tuple(int(x[begin]) for x in place)
            if key != own_key:
                key, forest = own_key, Forest()
                units, labels = np.zeros((0, own_key[0])), np.zeros(0, np.int64)
            for at in range(begin, end, 512):
                to = min(end, at + 512)
                new, own = _units(vecs.slice(at, to - at), own_key[0], dtype), component[at:to]
                if not query[begin]:
                    units, labels = np.concatenate([units, new]), np.concatenate([labels, own])
                near = (new @ units.T >= cosine) & (own[:, None] != labels[None, :])
                for i in np.flatnonzero(near.any(axis=1)):
                    for other in np.unique(labels[near[i]]).tolist():
                        if forest.join(int(own[i]), other):
                            links[0].append(int(own[i]))
                            links[1].append(other)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])


def _crowded(classes: DataFrame, buckets: DataFrame, groups: DataFrame, dtype: str, cosine: float, most_pairs: float) -> DataFrame | None:
    """Links (a, b) of components inside `buckets` (dims, pass, bucket, vec_id, same), all of them; None if
    that takes more than `most_pairs` comparisons."""
    key = ["dims", "pass", "bucket"]
    at = stored(
        buckets.join(groups, F.col("vec_id") == F.col("node"), "left").select(
            *key, "same", F.coalesce("component", "vec_id").alias("component")
        )
    )
    open_ = stored(
        at.groupBy(*key, "component")
        .agg(F.count("*").alias("k"))
        .groupBy(*key)
        .agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("main"))
        .where("main.k < n")
        .select(
            *key,
            F.col("main.component").alias("main"),
            F.ceil((F.col("n") - F.col("main.k")) / BLOCK).cast("int").alias("blocks"),
            ((F.col("n") - F.col("main.k")) * F.col("n")).cast("double").alias("pairs"),
        )
    )
    if (open_.agg(F.sum("pairs")).first()[0] or 0) > most_pairs:
        return None
    salt = F.pmod(F.xxhash64("same"), "blocks").cast("int")
    rows = at.join(open_, key).select(
        *key,
        "same",
        "component",
        # A member outside the largest component is in a block, and meets the blocks before it.
        F.explode(
            F.when(F.col("component") == F.col("main"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
                F.sequence(F.lit(0), salt)
            )
        ).alias("block"),
        F.when(F.col("component") == F.col("main"), -1).otherwise(salt).alias("home"),
    )
    return (
        rows.withColumn("query", F.col("block") != F.col("home"))
        .join(classes.select("same", "vec"), "same")
        .select(*key, "block", "query", "component", "vec")
        .repartition(*key, "block")
        .sortWithinPartitions(*key, "block", "query")
        .mapInArrow(lambda b: _across(b, dtype, cosine), "a long, b long")
    )


def _angles(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        angle = np.zeros(len(batch))
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims):
            own = pa.array(np.flatnonzero(dims == d))
            part = batch.take(own)
            a, b = (_units(part.column(n), int(d), dtype) for n in ("vec", "centre"))
            angle[dims == d] = np.arccos(np.clip((a * b).sum(axis=1), -1, 1))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in ("component", "vec_id", "size", "dims", "vec")], pa.array(angle)],
            ["component", "vec_id", "size", "dims", "vec", "angle"],
        )


def _count(batches: Iterator[pa.RecordBatch], dtype: str, cosine: float) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (component, dims, block, query): links of queries to the block's members (sizes
    summed), and of its inner members to queries. Queries stream past the block."""
    key, ids, units, sizes, core, got = None, [], None, None, None, None

    def flush() -> pa.RecordBatch:
        inner = np.flatnonzero(core & (got > 0)) if key is not None and units is not None else np.zeros(0, int)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[inner] if len(inner) else [], pa.int64()), pa.array(got[inner] if len(inner) else [], pa.int64())],
            ["vec_id", "n"],
        )

    for batch in batches:
        group = list(zip(*[batch.column(n).to_pylist() for n in ("component", "dims", "block", "query")]))
        cuts = [i for i in range(1, len(group)) if group[i] != group[i - 1]]
        for begin, end in zip([0, *cuts], [*cuts, len(group)]):
            part = batch.slice(begin, end - begin)
            own_ids, own_sizes = part.column("vec_id").to_numpy(), part.column("size").to_numpy()
            own = _units(part.column("vec"), part.column("dims")[0].as_py(), dtype)
            own_core = part.column("core").to_numpy(zero_copy_only=False)
            if group[begin][:3] != key:
                if key is not None:
                    yield flush()
                key, ids, units, sizes, core = group[begin][:3], own_ids, own, own_sizes, own_core
                got = np.zeros(len(ids), np.int64)
            elif not group[begin][3]:  # the block goes on in this batch
                ids, units = np.concatenate([ids, own_ids]), np.concatenate([units, own])
                sizes, core = np.concatenate([sizes, own_sizes]), np.concatenate([core, own_core])
                got = np.zeros(len(ids), np.int64)
            if group[begin][3]:
                for at in range(0, len(own), 1024):
                    near = own[at : at + 1024] @ units.T >= cosine
                    got += near.T @ own_sizes[at : at + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own_ids[at : at + 1024]), pa.array(near @ sizes)], ["vec_id", "n"]
                    )
    if key is not None:
        yield flush()


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS, seed: int = 7) -> DataFrame:
    """Per vector: vec_id, n_links (other rows with a cosine of at least `cosine`, inside the
    component found), component_id (smallest vec_id reachable over links), kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, and so do rows without vec_id (component_id null, kept). Vectors of different
    lengths are never linked. Rows that repeat a vec_id count as vectors of their own in
    n_links, and as one node in components. Other columns are ignored.
    """
    kind = dict(embeddings.dtypes)["embedding"]
    dtype = "float32" if kind == "array<float>" else "float64"
    source = plain(embeddings, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    if dtype == "float64":
        source = source.withColumn("embedding", F.col("embedding").cast("array<double>"))
    read = stored(
        source.mapInArrow(lambda b: _normal(b, dtype), "vec_id long, dims int, vec binary, same binary")
    )
    classes = stored(
        read.where("same IS NOT NULL AND vec_id IS NOT NULL")
        .groupBy("same")
        .agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"), F.first("dims").alias("dims"), F.first("vec").alias("vec"))
    )
    n = classes.count()
    passes, bits = passes_needed(n, cosine, window, miss), bucket_bits(n, window)
    found = stored(
        classes.mapInArrow(
            lambda b: _keys(b, passes, dtype, seed, "vec"), "pass int, key long, vec_id long, dims int, vec binary"
        )
        .repartitionByRange("dims", "pass", "key", "vec_id")
        .sortWithinPartitions("dims", "pass", "key", "vec_id")
        .mapInArrow(lambda b: _neighbours(b, dtype, cosine, window), "a long, b long, dims int, pass int, key long")
    )
    links = found.where("a IS NOT NULL").select("a", "b")
    groups = stored(components(links))
    bucket = F.shiftright("key", BITS - bits).alias("bucket")
    keyed = stored(
        classes.mapInArrow(
            lambda b: _keys(b, passes, dtype, seed, "same"), "pass int, key long, vec_id long, dims int, same binary"
        ).select("dims", "pass", bucket, "vec_id", "same")
    )
    crowds = (
        keyed.groupBy("dims", "pass", "bucket")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > window + 1)
        .drop("n")
        .unionByName(found.where("a IS NULL").select("dims", "pass", bucket))
        .distinct()
    )
    all_pairs = classes.groupBy("dims").count().agg(F.sum(F.expr("double(count) * count"))).first()[0] or 0
    more = _crowded(classes, keyed.join(crowds, ["dims", "pass", "bucket"]), groups, dtype, cosine, all_pairs)
    if more is None:
        whole = classes.select("dims", F.lit(0).alias("pass"), F.lit(0).cast("long").alias("bucket"), "vec_id", "same")
        more = _crowded(classes, whole, groups, dtype, cosine, math.inf)
    groups = stored(components(links.unionByName(more)))
    members = stored(
        classes.join(groups, F.col("vec_id") == F.col("node")).select("component", "vec_id", "size", "dims", "vec")
    )
    # Rows that share a vec_id may differ in length; only vectors of one length are compared.
    centres = stored(members.groupBy("component", "dims").agg(F.min_by("vec", F.struct("vec_id", "vec")).alias("centre")))
    half = math.acos(cosine) / 2 - 1e-9
    placed = stored(
        members.join(centres, ["component", "dims"])
        .mapInArrow(
            lambda b: _angles(b, dtype), "component long, vec_id long, size long, dims int, vec binary, angle double"
        )
        .withColumn("core", F.col("angle") <= half)
    )
    sums = stored(
        placed.groupBy("component", "dims").agg(
            F.sum(F.when(F.col("core"), F.col("size")).otherwise(0)).alias("core_size"),
            F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("outer"),
            F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        )
    )
    known = placed.join(sums, ["component", "dims"])
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    fields = ["component", "block", "query", "vec_id", "size", "dims", "vec", "core"]
    dealt = known.where("outer > 0").withColumn("query", F.lit(False)).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    queries = known.where("NOT core").withColumn("query", F.lit(True)).withColumn("block", F.explode(blocks))
    counted = (
        dealt.select(fields)
        .unionByName(queries.select(fields))
        .repartition("component", "dims", "block")
        .sortWithinPartitions("component", "dims", "block", "query")
        .mapInArrow(lambda b: _count(b, dtype, cosine), "vec_id long, n long")
        .groupBy("vec_id")
        .agg(F.sum("n").alias("n"))
    )
    result = stored(
        known.join(counted, "vec_id", "left")
        .join(classes.select("vec_id", "same"), "vec_id")
        .select(
            "same",
            F.col("component").alias("component_id"),
            (F.when(F.col("core"), F.col("core_size")).otherwise(0) + F.coalesce("n", F.lit(0)) - 1).alias("n_links"),
        )
        .unionByName(
            classes.join(groups, F.col("vec_id") == F.col("node"), "left_anti").select(
                "same", F.col("vec_id").alias("component_id"), (F.col("size") - 1).alias("n_links")
            )
        )
    )
    usable = F.col("vec_id").isNotNull()
    return (
        read.select("vec_id", "same")
        .join(result, "same", "left")
        .select(
            "vec_id",
            F.when(usable, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            F.when(usable, F.coalesce("component_id", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(True)))
    )
