"""Substring dedup against brute force over all windows."""

import hashlib
import random

from sheetgrid.llm import substring
from tests.llm.conftest import rows_of


def brute(docs, size):
    lists = [(i, (t or "").encode().split()) for i, t in docs]
    starts = {}
    for i, words in lists:
        for p in range(len(words) - size + 1):
            key = tuple(words[p : p + size])
            starts[key] = min(starts.get(key, i), i)
    out = []
    for i, words in lists:
        bad = set()
        for p in range(len(words) - size + 1):
            if starts[tuple(words[p : p + size])] < i:
                bad |= set(range(p, p + size))
        kept = [w for k, w in enumerate(words) if k not in bad]
        out.append((i, len(words), len(bad), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 130)]
    docs = []
    for i in range(90):
        words = [word() for _ in range(rng.choice([0, 3, 49, 50, 80, 300]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        if rng.random() < 0.2 and docs:
            words = docs[rng.randrange(len(docs))][1].split()
        if rng.random() < 0.1:
            words = ["same"] * 120 + words
        docs.append((i, "\n".join(words)))
    rng.shuffle(docs)
    return docs


def test_same_words_removed_as_by_brute_force(spark):
    docs = corpus()
    got = substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute(docs, 50)


def test_other_sizes_and_texts(spark):
    docs = [(1, "a b c d e f"), (2, "x a b c d y"), (3, "a b c q c d e f"), (4, "b c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = substring.remove_repeats(df, size=3).cache()
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute(docs, 3)
    assert rows_of(substring.cut_texts(df, got), "doc_id", "text") == [(1, "a b c d e f"), (2, "x y"), (3, "q"), (4, "")]


def test_intervals_are_maximal():
    import numpy as np

    assert substring.removal_intervals(np.array([0, 1, 4, 9]), 3) == [(0, 7), (9, 12)]
    assert substring.removal_intervals(np.array([], dtype=int), 3) == []


def test_awkward_rows(awkward, nothing):
    got = rows_of(substring.remove_repeats(awkward), "doc_id", "n_words", "n_removed")
    assert got == sorted(
        [(1, 10, 0), (1, 10, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (None, 10, 0), (5, 3000, 0), (6, 3000, 3000), (7, 1, 0), (7, 2, 0)],
        key=repr,
    )
    assert substring.remove_repeats(nothing).collect() == []
