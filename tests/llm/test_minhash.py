"""MinHash near-dedup against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sheetgrid.llm import minhash, rolling
from tests.llm.conftest import rows_of


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[i]), root(i), root(i) == i) for i in ids), key=repr)


def corpus():
    """Chains and stars of edits: members of a group are often linked only through others."""
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(400)] + ["Ärger", "ÉTÉ", "naïve"]
    docs, group = [], []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 40, 200]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            group.append(" ".join(words))
            if rng.random() < 0.3:
                group.append(" ".join(words).upper().lower() + " ")
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    rng.shuffle(group)
    for i, text in enumerate(group):
        docs.append((i, text))
    return docs


def test_same_components_as_all_pairs(spark):
    docs = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute(docs)


def test_every_pair_in_a_template_bucket_is_tested(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4000, raising=False)
    template = " ".join(f"t{i}" for i in range(100))
    docs = []
    for i in range(300):  # all alike by 0.70; of each of 120 pairs, 8 words more
        tail = [f"p{i // 2 if i < 240 else i}x{k}" for k in range(8)] + [f"u{i}x{k}" for k in range(12)]
        docs.append((i, f"{template} {' '.join(tail)}"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, bands=1, rows=2).collect()}
    keys = []
    for c in rolling.chunks(pa.array([t for _, t in docs]), lower=True):
        keys += minhash.band_keys(minhash.one_permutation(*minhash.shingle_sets(c, 5), 2), 1, 2)[:, 0].tolist()
    shared = [i for i in range(0, 240, 2) if keys[i] == keys[i + 1]]
    assert len(shared) >= 15
    assert [i for i in shared if got[i + 1] != i] == []
    want = {i: c for i, _, c, _ in brute(docs)}
    assert all(got[i] in (i, want[i]) for i in want)


def test_awkward_rows(awkward, nothing):
    got = rows_of(minhash.near_duplicates(awkward), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(
        [
            (1, 6, 1, True),
            (1, 6, 1, True),
            (2, 0, 2, True),
            (3, 0, 3, True),
            (4, 0, 4, True),
            (None, 6, None, True),
            (5, 2996, 5, True),
            (6, 2996, 5, False),
            (7, 1, 7, True),
            (7, 1, 7, True),
        ],
        key=repr,
    )
    assert minhash.near_duplicates(nothing).collect() == []


def test_one_permutation_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (6, 40, 4000):
        common = np.unique(rolling.mix(rng.integers(1, 1 << 62, n, dtype=np.int64).astype(np.uint64)))
        own = np.unique(rolling.mix(rng.integers(1, 1 << 62, n // 3, dtype=np.int64).astype(np.uint64)))
        sets = [common, np.union1d(common, own)]
        sketch = minhash.one_permutation(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 128)
        assert not (sketch == np.iinfo(np.uint64).max).any()
        assert abs((sketch[0] == sketch[1]).mean() - len(common) / len(sets[1])) < 0.2


@pytest.mark.parametrize("lower", [False, True])
def test_words_and_windows_do_not_depend_on_chunks(lower):
    texts = pa.array(["A b\tc", None, "", "\x0b a  b c\r\n", "ünï b c a b c", "c"] * 5)
    words = {}
    for chunk_bytes in (1, 16, 1 << 20):
        hashes = []
        for c in rolling.chunks(texts, lower, chunk_bytes):
            spans = [c.data[a:b].tobytes() for a, b in zip(c.starts, c.ends)]
            for h, w in zip(c.words.tolist(), spans):
                assert words.setdefault(h, w.lower() if lower else w) == (w.lower() if lower else w)
            h, at = rolling.windows(c, 3)
            hashes += zip(h.tolist(), (c.first + c.row_of_word()[at]).tolist())
            assert [s.split() for s in (t.encode() if t else b"" for t in texts[c.first : c.last].to_pylist())] == [
                spans[a:b] for a, b in zip(c.bounds, c.bounds[1:])
            ]
        assert len(words) == len(set(words.values()))
        first = hashes if chunk_bytes == 1 else first
        assert hashes == first
