"""Toxicity behind obfuscation: decode disguised words, then score the restored text.

* A character language model, bigram counts over the words of all documents, is gathered in Spark;
  it has a fixed number of cells.
* Words that could be disguised are found by array operations over whole texts: a sign or digit
  among letters (leetspeak), a letter three times in a row, or single letters in a row
  (spacing, with or without dots and dashes between or standing free). Each gives a lattice of
  characters, repeats collapsed; Viterbi decoding under the language model keeps its best few
  readings, of long lattices in stretches that overlap by more than a word.
* Words of the restored text give features: the word and its beginnings of 4 to 8 bytes. Where words
  were run together by spelling or gluing, each letter of a reading may begin a word. Their
  weights are log odds over labelled documents, counted by families of near copies. A logistic
  regression on what a text hits gives the score.

The model is fitted on at most `bound` labelled documents (the first by a hash of the id); the
language model and the scores cover every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgrid.llm import rolling
from sheetgrid.llm.common import plain, stored

BOUND = 6000
THRESHOLD = 0.7
LEAST_FAMILIES = 3
LEAST_WEIGHT = 1.5
READINGS = 6
PREFIXES = (4, 5, 6, 7, 8)

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "",
}
_SUBSTITUTED = math.log(0.2)
_DROPPED = math.log(0.3)
#: Places of a lattice decoded together, and how many of them the next stretch has, too.
_STRETCH, _OVERLAP = 64, 24
#: A word that begins inside a reading counts from so many bytes.
_INNER = 5

# Character classes of the language model: boundary, a-z, letters U+00E0-U+00FF, other letters.
CLASSES = 1 + 26 + 32 + 1
_CLASS = np.zeros(256, dtype=np.int16)
for _c in range(26):
    _CLASS[ord("a") + _c] = _CLASS[ord("A") + _c] = 1 + _c
_CLASS[0xC4:] = CLASSES - 1
_CLASS[0x80:0xC4] = -1
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 256)]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in "0123456789@$!|+(*"]] = True
_CORE = _LETTER.copy()
_CORE[[*range(ord("0"), ord("9") + 1)]] = True
_HEAD = _CORE.copy()
_HEAD[[ord(c) for c in "@$"]] = True


def char_class(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if "à" <= c <= "ÿ":
        return 27 + ord(c) - 0xE0
    return CLASSES - 1 if c.isalpha() else 0


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    for batch in batches:
        for c in rolling.chunks(batch.column("text")):
            if len(c.data):
                kind = _CLASS[c.data]
                after = np.zeros(len(kind), dtype=bool)
                after[1:] = (c.data[:-1] == 0xC3) & (c.data[1:] < 0xC0)
                kind[after] = 27 + (c.data[after] & 0x1F)
                kind = kind[kind >= 0].astype(np.int64)
                counts += np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["cell", "n"])


def language_model(documents: DataFrame) -> np.ndarray:
    """Log probabilities [before, after] of character classes, from all documents."""
    cells = (
        plain(documents, "text").mapInArrow(_bigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    )
    counts = np.full(CLASSES * CLASSES, 0.1)
    for row in cells.collect():  # at most CLASSES squared
        counts[row["cell"]] += row["n"]
    counts = counts.reshape(CLASSES, CLASSES)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per place of a disguised word: what it may have been, with log weights."""
    places, i = [], 0
    while i < len(token):
        c, n = token[i], 1
        while i + n < len(token) and token[i + n] == c:
            n += 1
        if c.isalpha():
            if n >= 3:
                places.append([(c, 0.0), (c + c, _DROPPED)])
            else:
                places += [[(c, 0.0)]] * n
        elif c in LEET:
            choices = [(x, _SUBSTITUTED) for x in LEET[c]] or [("", _DROPPED)]
            places += [choices] * (n if n < 3 else 1)
        # Anything else is spacing: dots, dashes and the like drop out.
        i += n
    return places


def decode(token: str, model: np.ndarray, readings: int = READINGS) -> list[str]:
    """The best readings of a disguised word (lower case), best first: Viterbi over its lattice,
    keeping `readings` paths per last character."""
    return _decode_places(lattice(token.lower()), model, readings)


def decode_long(token: str, model: np.ndarray, readings: int = READINGS) -> list[tuple[int, str]]:
    """(rank, reading) of a word or run of any length: of its overlapping stretches, if it is long."""
    places, found, at = lattice(token.lower()), [], 0
    while True:
        found += enumerate(_decode_places(places[at : at + _STRETCH], model, readings))
        if at + _STRETCH >= len(places):
            return found
        at += _STRETCH - _OVERLAP


def _decode_places(places: list, model: np.ndarray, readings: int) -> list[str]:
    paths: dict[str, list[tuple[float, str]]] = {"": [(0.0, "")]}
    for choices in places:
        grown: dict[str, list[tuple[float, str]]] = {}
        for last, own in paths.items():
            for text, weight in choices:
                step, before = weight, char_class(last) if last else 0
                for c in text:
                    step += model[before, char_class(c)]
                    before = char_class(c)
                grown.setdefault(text[-1:] or last, []).extend((s + step, t + text) for s, t in own)
        paths = {c: sorted(own, reverse=True)[:readings] for c, own in grown.items()}
    ends = [(s + (model[char_class(c), 0] if c else 0.0), t) for c, own in paths.items() for s, t in own]
    return [t for _, t in sorted(ends, reverse=True)[:readings]]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _cores(c: rolling.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends): lower-cased bytes, and each word without signs around it."""
    data = _LOWER[c.data]
    capital = np.zeros(len(data), dtype=bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    data[capital] += 32
    place = np.arange(len(data))
    last = np.maximum.accumulate(np.where(_CORE[data], place, -1)) if len(data) else place
    first = np.minimum.accumulate(np.where(_HEAD[data], place, len(data))[::-1])[::-1] if len(data) else place
    ends = np.maximum(last[c.ends - 1] + 1, c.starts) if len(c.starts) else c.ends
    starts = np.minimum(first[c.starts], ends) if len(c.starts) else c.starts
    return data, starts, ends


def _disguised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, c: rolling.Chunk) -> tuple[np.ndarray, list]:
    """(mixed, runs): words to decode alone, and (first, last) words that are spaced letters."""
    n = len(data)
    mark = np.zeros(n + 1, dtype=np.int64)
    if n > 1:
        letter, sign = _LETTER[data], _SIGN[data]
        hit = np.zeros(n, dtype=bool)
        hit[1:] = (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
        # Letters with dots, dashes and such between them: three pairs at least.
        hit[2:] |= letter[2:] & letter[:-2] & ~letter[1:-1] & ~rolling._SPACE[data[1:-1]]
        hit[2:] |= (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:] & (data[2:] < 0x80)
        mark[1:] = np.cumsum(hit)
    long = ends - starts
    mixed = np.flatnonzero((mark[ends] - mark[np.minimum(starts + 1, ends)] > 0) & (long > 2))
    single = (long == 1) & _CORE[data[np.minimum(starts, max(n - 1, 0))]] if n else long == 1
    runs = []
    if single.any():
        text = c.row_of_word()
        spelled = single | (long == 0)  # signs that stand free between letters belong to the run
        edge = np.flatnonzero(np.diff(np.concatenate([[0], spelled.astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2]):
            for part in np.split(np.arange(a, b), np.flatnonzero(np.diff(text[a:b])) + 1):
                letters = part[single[part]]
                if len(letters) >= 3:
                    runs.append((letters[0], letters[-1]))
    return mixed, runs


def _hash_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, which): feature hashes of restored words, and of what begins at each letter inside them;
    as `_features` for words in place. The shortest beginnings count at a word's own start only."""
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    which = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(which)) + which  # one space after each word
    inner = (ends[which] - place >= _INNER) & (place > (ends - size)[which]) & ((data[place] & 0xC0) != 0x80)
    place, owner = place[inner], which[inner]
    inside = _features(data, place, ends[owner])
    inside[:, 1 : 1 + sum(n < _INNER for n in PREFIXES)] = 0
    return np.concatenate([_features(data, ends - size, ends), inside]), np.concatenate([np.arange(len(words)), owner])


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of each word's whole and of its beginnings; 0 where a word is too short."""
    up, down = rolling._BYTE_POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(rolling._BYTES[data] * up[: len(data)], out=sums[1:])
    out = np.zeros((len(starts), 1 + len(PREFIXES)), dtype=np.uint64)
    long = ends - starts
    some = long >= 3
    out[some, 0] = rolling.mix((sums[ends[some]] - sums[starts[some]]) * down[starts[some]])
    for k, size in enumerate(PREFIXES, 1):
        some = long > size
        at = starts[some]
        out[some, k] = rolling.mix((sums[at + size] - sums[at]) * down[at] + np.uint64(size))
    return out


_decoded: dict[str, list[tuple[int, str]]] = {}


class Restored:
    """The words of a chunk after decoding: feature hashes and text of each word.

    `hashes` [words, 6] has the words as they stand, followed by the readings of disguised
    ones, best first; `row` is the text of each, `reading` its rank (0: the best or the only).
    """

    def __init__(self, c: rolling.Chunk, model: np.ndarray):
        data, starts, ends = _cores(c)
        text = c.row_of_word()
        self.hashes, self.row = _features(data, starts, ends), text
        self.reading = np.zeros(len(text), dtype=np.int8)
        mixed, runs = _disguised(data, starts, ends, c)
        words, rows, ranks, gone = [], [], [], []
        for first, last in [*zip(mixed, mixed), *runs]:
            token = b"".join(data[starts[i] : ends[i]].tobytes() for i in range(first, last + 1)).decode("utf-8", "replace")
            if token not in _decoded:
                if len(_decoded) > 200_000:
                    _decoded.clear()
                _decoded[token] = decode_long(token, model)
            gone += range(first, last + 1)
            for k, reading in _decoded[token]:
                if reading:
                    words.append(reading.encode())
                    rows.append(text[first])
                    ranks.append(k)
        if gone:
            self.hashes[gone] = 0
        if words:
            hashes, which = _hash_words(words)
            self.hashes = np.concatenate([self.hashes, hashes])
            self.row = np.concatenate([self.row, np.array(rows)[which]])
            self.reading = np.concatenate([self.reading, np.array(ranks, dtype=np.int8)[which]])


def _training(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, fold, family) of each labelled text, once each.

    The family is the smallest word hash of the text: near copies mostly share it.
    """
    for batch in batches:
        toxic, fold = batch.column("toxic").to_numpy(), batch.column("fold").to_numpy()
        for c in rolling.chunks(batch.column("text")):
            found = Restored(c, model)
            best = found.reading == 0
            order = np.argsort(found.row[best], kind="stable")
            hashes, row = found.hashes[best][order], found.row[best][order]
            bounds = np.searchsorted(row, np.arange(c.last - c.first + 1))
            for i in range(c.last - c.first):
                own = np.unique(hashes[bounds[i] : bounds[i + 1]])
                own = own[own != 0]
                words = c.words[c.bounds[i] : c.bounds[i + 1]]
                family = int(words.min()) >> 1 if len(words) else 0
                k = c.first + i
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.view(np.int64)),
                        pa.array(np.full(len(own), toxic[k], np.int32)),
                        pa.array(np.full(len(own), fold[k], np.int32)),
                        pa.array(np.full(len(own), family, np.int64)),
                    ],
                    ["feature", "toxic", "fold", "family"],
                )


class Weights:
    """Weights by feature hash, with a small table that dismisses most words at once."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.table = np.zeros(1 << 16, dtype=bool)
        self.table[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(hashes.shape)
        some = self.table[(hashes >> np.uint64(48)).astype(np.int64)] & (hashes != 0)
        if len(self.hashes) and some.any():
            own = hashes[some]
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            out[some] = np.where(self.hashes[at] == own, self.weights[at], 0.0)
        return out


def evidence(c: rolling.Chunk, model: np.ndarray, weights: Weights) -> np.ndarray:
    """[texts, 5]: strongest weight, sums and counts of hits, hits per word."""
    found = Restored(c, model)
    weight = weights.of(found.hashes).max(axis=1) if len(found.hashes) else np.zeros(0)
    n = c.last - c.first
    out = np.zeros((n, 5))
    hit = weight > 0
    rows = found.row[hit]
    np.maximum.at(out[:, 0], rows, weight[hit])
    out[:, 1] = np.log1p(np.bincount(rows, weights=weight[hit], minlength=n))
    count = np.bincount(rows, minlength=n)
    out[:, 2] = np.log1p(count)
    words = np.maximum(np.diff(c.bounds), 1)
    out[:, 3] = np.sqrt(100.0 * count / words)
    strong = np.bincount(found.row[weight > 3.0], minlength=n)
    out[:, 4] = np.log1p(strong)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights, the constant last, of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * len(x) * w * np.array([1.0] * (len(w) - 1) + [0.0]) * 0.01
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(len(w)) + ridge * 0.01 * len(x) * np.diag([1.0] * (len(w) - 1) + [0.0])
        w = w - np.linalg.solve(bend, slope)
    return w


def _weights(counts: list, folds: set[int], families: dict) -> Weights:
    """Log odds of features, from counts (feature, toxic, fold, n) of families in `folds`."""
    n = [sum(families.get((t, f), 0) for f in folds) for t in (0, 1)]
    table: dict[int, list[int]] = {}
    for feature, toxic, fold, k in counts:
        if fold in folds:
            table.setdefault(feature, [0, 0])[toxic] += k
    hashes, weights = [], []
    for feature, (clean, toxic) in table.items():
        if toxic >= LEAST_FAMILIES:
            w = math.log((toxic + 0.1) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1))
            if w >= LEAST_WEIGHT:
                hashes.append(feature & 0xFFFFFFFFFFFFFFFF)
                weights.append(w)
    return Weights(np.array(hashes, dtype=np.uint64), np.array(weights))


def fit(documents: DataFrame, labels: DataFrame, model: np.ndarray, bound: int = BOUND) -> tuple[Weights, np.ndarray] | None:
    """(feature weights, regression weights) from at most `bound` labelled documents; None without
    both labels. `labels` has doc_id and toxic."""
    chosen = stored(
        plain(labels, "doc_id", "toxic")
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    texts = stored(
        plain(documents, "doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # `bound` records at most
        .select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("fold"))
    )
    found = texts.mapInArrow(lambda b: _training(b, model), "feature long, toxic int, fold int, family long")
    counted = (
        found.groupBy("feature", "toxic", "fold")
        .agg(F.count_distinct("family").alias("n"))
        .withColumn("most", F.sum(F.expr("if(toxic = 1, n, 0)")).over(_by_feature()))
        .where(F.col("most") >= LEAST_FAMILIES)
        .select("feature", "toxic", "fold", "n")
        .collect()  # of `bound` documents
    )
    sizes = {(r["toxic"], r["fold"]): r["count"] for r in texts.groupBy("toxic", "fold").count().collect()}
    if not any(t for t, _ in sizes) or all(t for t, _ in sizes):
        return None
    half = {f: _weights(counted, {1 - f}, sizes) for f in (0, 1)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for c in rolling.chunks(batch.column("text")):
                both = np.stack([evidence(c, model, half[f]) for f in (0, 1)])
                x = both[fold[c.first : c.last], np.arange(c.last - c.first)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic").slice(c.first, len(x))], ["x", "y"]
                )

    seen = texts.mapInArrow(rows, "x array<double>, y int").collect()  # `bound` records at most
    seen = sorted((list(r["x"]), r["y"]) for r in seen)
    return _weights(counted, {0, 1}, sizes), logistic(np.array([x for x, _ in seen]), np.array([y for _, y in seen], dtype=float))


def _by_feature():
    from pyspark.sql import Window

    return Window.partitionBy("feature")


def score(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = BOUND) -> DataFrame:
    """Per document: doc_id, score (0 to 1), predicted.

    `labels` (doc_id, toxic) are the rows to learn from. A score depends on the text alone. Null
    and empty texts get the score of a text without any evidence; so do all texts if
    the labels lack either class (0 then). Rows are scored one by one, whatever their
    doc_id. Other columns are ignored.
    """
    model = language_model(documents)
    fitted = fit(documents, labels, model, bound)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in rolling.chunks(batch.column("text")):
                if fitted is None:
                    p = np.zeros(c.last - c.first)
                else:
                    weights, w = fitted
                    p = 1 / (1 + np.exp(-np.clip(evidence(c, model, weights) @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(c.first, len(p)),
                        pa.array(p),
                        pa.array((p >= threshold).astype(np.int32)),
                    ],
                    ["doc_id", "score", "predicted"],
                )

    source = plain(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(rows, "doc_id long, score double, predicted int")


def held_out(doc_id) -> object:
    """Whether a document is held out of training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
