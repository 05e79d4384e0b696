"""Spelling variant grouping by bidirectional FM-index search schemes.

Vocabulary: words of all texts with their counts, by sorting pointers over the Arrow buffers
(`pointers`), so that equal words are equal byte for byte.

Search: two words that differ by one code point share one half of the shorter one, at its own end
of the word. Words are dealt by these halves (class = the shorter word's length, side, half)
into blocks; a half that very many words share is dealt over several blocks, and its queries visit
each. A block's task builds a bidirectional FM-index over its delimited words and runs both
search schemes on it: match a half exactly from the middle outwards to its delimiter, then turn and
extend across the other half, allowing one error, up to the delimiter there. Intervals
of suffix ranks in the text and in its reverse are kept in step, so that a search can turn. A word
that is found is named by its rank.

Forms: the near word of largest count is a word's form if it occurs `factor` times as often. Counts
grow by that factor along forms, so there are no circles, and the way to the root, below 64
bits, has at most 27 steps: five doublings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgrid.llm import pointers
from sheetgrid.llm.common import forget, plain, stored

LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
#: A run in so many loses a letter.
NOISE = 199
#: Words of a block, about; queries that are searched together.
BLOCK_WORDS, TOGETHER = 20_000, 4096
#: Words up to so many bytes are hashed side by side, longer ones one by one.
_SIDE_BY_SIDE = 32

# ---- words


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of slices of a buffer, going on from the crc32 `before` each."""
    size = ends - starts
    by = np.argsort(-size, kind="stable")
    by, long = by[size[by] <= _SIDE_BY_SIDE], by[size[by] > _SIDE_BY_SIDE]
    out = np.zeros(len(starts), dtype=np.uint32)
    for i in long.tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]], int(before[i]))
    state, at, size = before[by].astype(np.uint32) ^ np.uint32(0xFFFFFFFF), starts[by], size[by]
    for k in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, side="left"))  # those with more than k bytes
        now = state[:m]
        state[:m] = _CRC[(now ^ data[at[:m] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[by] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of each shard, words of at least `least` code points."""
    for batch in batches:
        ids = [b"" if i is None else b"%d" % i for i in batch.column("doc_id").to_pylist()]
        head = np.array([zlib.crc32(i + b":") for i in ids], dtype=np.uint32)
        for first, last, data, offsets in pointers.shards(batch.column("text")):
            lead = data == 0xC3  # C3 80 to C3 BF are U+00C0 to U+00FF
            inside = ((data >= ord("a")) & (data <= ord("z"))) | lead
            inside[1:] |= lead[:-1]
            starts, ends, rows = pointers.slices(inside, offsets)
            leads = np.concatenate([[0], np.cumsum(lead)])
            letters = (ends - starts) - (leads[ends] - leads[starts])
            fit = letters >= least
            starts, ends, rows, letters = starts[fit], ends[fit], rows[fit], letters[fit]
            if not len(starts):
                continue
            h = crcs(data, starts, ends, head[first:last][rows])
            hit = h % NOISE == 0
            changed = []
            for i in np.flatnonzero(hit & (letters > least)).tolist():
                word = data[starts[i] : ends[i]].tobytes().decode()
                at = int(h[i]) % len(word)
                changed.append(word[:at] + word[at + 1 :])
            words = pointers.Words(data, starts[~hit], ends[~hit])
            order, new = pointers.sort(words)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(order)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([words.strings(order[at]), pa.array(changed, pa.string())]),
                    pa.array(np.concatenate([n, np.ones(len(changed), np.int64)])),
                ],
                ["word", "n"],
            )


def vocabulary(documents: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences."""
    source = plain(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    counted = source.mapInArrow(lambda b: _counted(b, least_letters), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- index

#: a-z are symbols 1 to 26, U+00C0 to U+00FF 27 to 90, the delimiter 0.
SYMBOLS = 91


def encode(words: list[str]) -> np.ndarray:
    """Symbols of the words, one after the other."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.where(points < 0xC0, points - ord("a") + 1, points - 0xC0 + 27).astype(np.uint8)


def _rotations(text: np.ndarray) -> np.ndarray:
    """Start places of a cyclic text's rotations, in order, by prefix doubling."""
    n, rank, k = len(text), text.astype(np.int64), 1
    while True:
        key = rank * (rank.max() + 1) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        key = key[order]
        step = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        if step[-1] == n - 1 or k >= n:
            return order
        k *= 2


class Ranks:
    """Ranks of symbols in the Burrows-Wheeler transform of a cyclic text: one half of the index."""

    def __init__(self, text: np.ndarray):
        order = _rotations(text)
        self.starts = order
        self.n = len(text)
        turned = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=SYMBOLS))])[:SYMBOLS]
        self.blocks = (self.n >> 6) + 1
        by = np.argsort(turned, kind="stable")
        slot = turned[by].astype(np.int64) * self.blocks + (by >> 6)
        cut = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        bits = np.zeros(SYMBOLS * self.blocks, dtype=np.uint64)
        bits[slot[cut]] = np.bitwise_or.reduceat(np.uint64(1) << (by & 63).astype(np.uint64), cut)
        self.bits = bits
        ones = np.bitwise_count(bits).astype(np.int64).reshape(SYMBOLS, self.blocks)
        self.sums = (np.cumsum(ones, axis=1) - ones + self.before[:, None]).reshape(-1)

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """First rank of the symbol's rotations, plus its occurrences before a place."""
        slot = symbol * self.blocks + (place >> 6)
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[slot] + np.bitwise_count(self.bits[slot] & below)


class Index:
    """Bidirectional FM-index over sorted distinct words, each between delimiters.

    The text is cyclic: a delimiter, the first word, a delimiter, the second and so on. `ahead`
    prepends a symbol to what is matched, `back` (over the reversed text) appends one.
    """

    def __init__(self, words: list[str]):
        size = np.array([len(w) for w in words], dtype=np.int64)
        heads = np.concatenate([[0], np.cumsum(size + 1)])
        text = np.zeros(heads[-1], dtype=np.uint8)
        inside = np.ones(len(text), dtype=bool)
        inside[heads[:-1]] = False
        text[inside] = encode(words)
        self.ahead, self.back = Ranks(text), Ranks(text[::-1].copy())
        # A whole word's interval, delimiters included, begins with a delimiter on either side.
        self.word_ahead = np.searchsorted(heads, self.ahead.starts[: len(words)], side="right") - 1
        # In the reversed text a word stands after the delimiter that follows it in the text.
        end = len(text) - 1 - self.back.starts[: len(words)]
        self.word_back = (np.searchsorted(heads, end, side="right") - 2) % len(words)

    def near(self, queries: np.ndarray, half: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, word, inserted) of all words one error away from queries of one length.

        queries: symbols, [queries, length]. first: the first `half` symbols match and the error
        lies after them; else the last `half` do and it lies before. Errors are one symbol
        replaced, or one inserted into the query. The mirrored search swaps the directions.
        """
        if not first:
            queries = queries[:, ::-1]
        inner, outer = (self.ahead, self.back) if first else (self.back, self.ahead)
        names = self.word_back if first else self.word_ahead
        out = [_search(queries[i : i + TOGETHER], half, inner, outer, i) for i in range(0, len(queries), TOGETHER)]
        query, rank, inserted = (np.concatenate(x) for x in zip(*out))
        return query, names[rank], inserted


def _all(ranks: Ranks, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first rank, size) of the interval extended by each symbol: [intervals, symbols]."""
    symbols = np.arange(SYMBOLS)[None, :]
    start = ranks.step(symbols, low[:, None])
    return start, ranks.step(symbols, high[:, None]) - start


def _search(queries: np.ndarray, half: int, inner: Ranks, outer: Ranks, base: int):
    """One search scheme: inwards part exactly, towards its delimiter, then outwards with one error."""
    n, length = queries.shape
    queries = np.hstack([queries.astype(np.int64), np.zeros((n, 1), np.int64)])
    who = np.arange(n)
    low, other, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, inner.n)
    for k in [*range(half - 1, -1, -1), length]:  # the half from the middle out, then the delimiter
        start, size = _all(inner, low, high)
        symbol = queries[who, k][:, None]
        smaller = np.cumsum(size, axis=1) - size
        other = other + np.take_along_axis(smaller, symbol, 1)[:, 0]
        low, own = np.take_along_axis(start, symbol, 1)[:, 0], np.take_along_axis(size, symbol, 1)[:, 0]
        found = own > 0
        who, low, other, high = who[found], low[found], other[found], (low + own)[found]
    exact = (who, other, other + (high - low))
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    replaced = inserted = none
    for k in range(half, length + 1):
        who, low, high = exact
        start, size = _all(outer, low, high)
        wrong = size > 0
        wrong[:, 0] = False
        if k < length:  # the symbol itself is no error, and inserting it here is inserting it later
            wrong[np.arange(len(who)), queries[who, k]] = False
        at, symbol = np.nonzero(wrong)
        fresh = (who[at], start[at, symbol], start[at, symbol] + size[at, symbol])
        inserted = _go(_joined(inserted, fresh), queries, k, outer)
        replaced = _go(replaced, queries, k, outer)
        if k < length:
            replaced = _joined(replaced, fresh)
            exact = _go(exact, queries, k, outer)
    kind = np.concatenate([np.zeros(len(replaced[0]), bool), np.ones(len(inserted[0]), bool)])
    who, rank, _ = _joined(replaced, inserted)
    return who + base, rank, kind


def _go(state, queries: np.ndarray, k: int, ranks: Ranks):
    who, low, high = state
    symbol = queries[who, k]
    low, high = ranks.step(symbol, low), ranks.step(symbol, high)
    found = high > low
    return who[found], low[found], high[found]


def _joined(a, b):
    return tuple(np.concatenate(pair) for pair in zip(a, b))


# ---- grouping


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of a block, in both directions: word, other, other_n."""
    held = rows[rows["held"]].drop_duplicates("word").sort_values("word", ignore_index=True)
    words, counts = held["word"].tolist(), held["n"].to_numpy()
    found = [pd.DataFrame({"word": pd.Series(dtype=str), "other": pd.Series(dtype=str), "other_n": pd.Series(dtype="int64")})]
    asked = rows[rows["asks"]]
    if words and len(asked):
        index, names = Index(words), held["word"].to_numpy()
        for (length, first), own in asked.groupby(["class", "first"]):
            queries = encode(own["word"].tolist()).reshape(len(own), length)
            half = length // 2 if first else length - length // 2
            query, word, inserted = index.near(queries, half, first)
            mine, n = own["word"].to_numpy()[query], own["n"].to_numpy()[query]
            found.append(pd.DataFrame({"word": mine, "other": names[word], "other_n": counts[word]}))
            # A word without one of its letters asks for nothing here: its side of the pair.
            found.append(
                pd.DataFrame({"word": names[word[inserted]], "other": mine[inserted], "other_n": n[inserted]})
            )
    return pd.concat(found, ignore_index=True)


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, other, other_n): all pairs of words one error apart, both ways, once each.

    `words` has distinct words of at least `least_letters` code points, lower-case a-z and
    U+00C0 to U+00FF, and their n.
    """
    size = F.length("word")
    roles = [
        F.struct((size - k).alias("class"), F.lit(first).alias("first"), F.lit(k == 0).alias("asks"))
        for k in (0, 1)
        for first in (True, False)
    ]
    dealt = (
        words.withColumn("role", F.explode(F.array(*roles)))
        .select("word", "n", "role.*")
        .where(F.col("class") >= least_letters)
        .withColumn(
            "half",
            F.expr("IF(first, left(word, class div 2), right(word, class - class div 2))"),
        )
    )
    # Halves that more words share than a block takes are dealt over several; few, by their definition.
    crowds = (
        dealt.groupBy("class", "first", "half")
        .agg(F.count("*").alias("rows"))
        .where(F.col("rows") > block_words // 2)
        .withColumn("parts", F.expr(f"CAST(-((-2 * rows) div {block_words}) AS INT)"))
        .drop("rows")
    )
    blocks = max(1, -(-4 * words.count() // block_words))
    by_half = F.xxhash64("class", "first", "half")
    placed = (
        dealt.join(crowds, ["class", "first", "half"], "left")
        .withColumn("block", F.when(F.col("parts").isNull(), F.pmod(by_half, F.lit(blocks))).otherwise(by_half))
        .withColumn("own", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))
        .withColumn(
            "part",
            F.explode(F.expr("IF(asks AND parts IS NOT NULL, sequence(0, parts - 1), array(own))")),
        )
        .withColumn("held", F.col("part") == F.col("own"))
        .withColumn("crowd", F.col("parts").isNotNull())
        .select("crowd", "block", "part", "word", "n", "class", "first", "asks", "held")
    )
    found = placed.groupBy("crowd", "block", "part").applyInPandas(_block, "word string, other string, other_n long")
    return found.groupBy("word", "other").agg(F.max("other_n").alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form) without circles: forms followed to the last, by doubling."""
    top = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        up = top.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(top.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        forget(top)
        top = further.select("word", "root")
        if further.where("went").isEmpty():
            return top


def group_variants(
    documents: DataFrame,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    factor: int = FACTOR,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, one in 199 of them (by the crc32 of
    doc_id and run) without one letter; those of `least_letters` code points and
    `least_count` occurrences. Null and empty texts have none, a null doc_id is hashed as
    an empty one, repeated rows count again, other columns play no part; an empty table gives no
    rows. Of near words with equal counts the smallest is the form. The work on a word is
    linear in its length.
    """
    words = stored(vocabulary(documents, least_letters, least_count))
    near = near_words(words, least_letters, block_words)
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    fits = -F.col("best.less") >= factor * F.col("n")
    found = stored(
        words.join(best, "word", "left").select(
            "word",
            F.when(fits, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(fits, -F.col("best.less")).alias("form_n"),
        )
    )
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
