"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A dictionary is built from labelled text of either class, without lines that both have. A text is compressed block by block with
both; the class whose dictionary saves more is the one it resembles. The evidence is the
difference of the compressed sizes, normalised by the larger one, beside the two sizes per
byte. A logistic regression turns it into a probability; its rows are labelled texts whose
own half of the sample, copies included, was left out of the dictionaries they were compressed with.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgrid.llm.common import forget, plain, stored

THRESHOLD = 0.3
#: Labelled documents to learn from, samples of a class and half for its dictionary, bytes of a sample.
BOUND, SAMPLES, SAMPLE_BYTES = 6000, 16_000, 512
BLOCK_BYTES, DICTIONARY_BYTES, LEVEL = 1024, 110 << 10, 3


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from samples; of samples too few to choose from, their own bytes."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes of texts with the dictionary of bad (0) and of good (1) text."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.by_class = [self._compressor(d) for d in dictionaries]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content) if content else None
        if data:
            data.precompute_compress(level=LEVEL)
        kept = {"dict_data": data} if data else {}
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **kept)

    def evidence(self, text: bytes) -> tuple[float, float, float]:
        """(normalised difference, bad and good size per byte); zeros for an empty text."""
        if not text:
            return 0.0, 0.0, 0.0
        blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
        bad, good = (sum(len(c.compress(b)) for b in blocks) for c in self.by_class)
        return (bad - good) / max(bad, good), bad / len(text), good / len(text)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression, the constant last, for x as it is."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - middle) / spread, np.ones((len(x), 1))])
    penalty = ridge * len(x) * np.diag([1.0] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = probability(z[:, :-1], w)
        bend = (z * (p * (1 - p))[:, None]).T @ z + penalty
        w = w - np.linalg.solve(bend, z.T @ (p - y) + penalty @ w)
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] / spread) @ middle)


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `half` by the smallest hash of three words in a row: near copies mostly share it."""
    for batch in batches:
        half = []
        for text in batch.column("text"):
            words = (text.as_py() or "").encode().split()
            half.append(min(zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))) % 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("text"), batch.column("good"), pa.array(half, pa.int32())], ["text", "good", "half"]
        )


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(good, half, sample) of all lines of the texts, long ones in pieces."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for good, half, text in zip(batch.column("good").to_pylist(), batch.column("half").to_pylist(), texts):
            lines = (text or "").encode().split(b"\n")
            pieces = [x[i : i + SAMPLE_BYTES] for x in lines for i in range(0, len(x), SAMPLE_BYTES)]
            n = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array([good] * n, pa.int32()), pa.array([half] * n, pa.int32()), pa.array(pieces, pa.binary())],
                ["good", "half", "sample"],
            )


def _evidence(batches: Iterator[pa.RecordBatch], halves: dict[int, tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    sizes = {half: Sizes(d) for half, d in halves.items()}
    for batch in batches:
        texts, half = batch.column("text").to_pylist(), batch.column("half").to_pylist()
        x = [list(sizes[h].evidence((t or "").encode())) for t, h in zip(texts, half)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("good")], ["x", "y"])


def fit(
    documents: DataFrame, labels: DataFrame, bound: int = BOUND, samples: int = SAMPLES
) -> tuple[tuple[bytes, bytes], np.ndarray] | None:
    """(dictionaries of bad and good text, regression weights); None unless both classes are labelled.

    At most `bound` labelled documents are learnt from, and at most `samples` lines per class and
    half go into dictionaries, chosen by hash: what comes to the driver has that bound. `labels` has
    doc_id and quality; of a doc_id labelled twice the smaller label counts.
    """
    chosen = stored(
        plain(labels, "doc_id", "quality")
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    texts = stored(
        plain(documents, "doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # `bound` records at most
        .select("text", "good")
        .mapInArrow(_halved, "text string, good int, half int")
    )
    lines = texts.mapInArrow(_samples, "good int, half int, sample binary").distinct()
    # What both classes hold, such as shared passages and notices, tells them not apart.
    own_lines = lines.groupBy("sample").agg(F.min("good").alias("least"), F.max("good").alias("most")).where("least = most")
    pieces = stored(lines.join(own_lines.select("sample"), "sample"))
    own: dict[tuple[int, int], list[bytes]] = {}
    for good in (0, 1):
        for half in (0, 1):
            some = pieces.where((F.col("good") == good) & (F.col("half") == half))
            order = [F.xxhash64("sample"), F.col("sample")]
            own[good, half] = [bytes(r[0]) for r in some.select("sample").orderBy(*order).limit(samples).collect()]
    if any(not (own[good, 0] or own[good, 1]) for good in (0, 1)):
        return None
    # The dictionaries for texts of one half come from the other.
    halves = {half: tuple(dictionary(own[good, 1 - half]) for good in (0, 1)) for half in (0, 1)}
    seen = texts.mapInArrow(lambda b: _evidence(b, halves), "x array<double>, y int").collect()  # `bound` rows
    seen = sorted((list(r["x"]), r["y"]) for r in seen)
    whole = tuple(dictionary(own[good, 0] + own[good, 1]) for good in (0, 1))
    for table in (chosen, texts, pieces):
        forget(table)
    return whole, logistic(np.array([x for x, _ in seen]), np.array([y for _, y in seen], dtype=float))


def score(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = BOUND) -> DataFrame:
    """Per document: doc_id, score (0 to 1, higher is better), predicted (1 from `threshold`).

    `labels` (doc_id, quality) are the rows to learn from. A score depends on the text alone, all of it.
    Null and empty texts get the score of a text without any evidence; unless both classes are
    labelled every text gets 0.5. Rows are scored one by one, whatever their doc_id. Other
    columns are ignored.
    """
    fitted = fit(documents, labels, bound)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(fitted[0]) if fitted else None
        for batch in batches:
            p = np.full(batch.num_rows, 0.5)
            if fitted and batch.num_rows:
                # One text at a time: a batch of long ones isn't held twice.
                p = probability(np.array([sizes.evidence((t.as_py() or "").encode()) for t in batch.column("text")]), fitted[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    source = plain(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(rows, "doc_id long, score double, predicted int")


def held_out(doc_id) -> object:
    """Whether a document is held out of training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
