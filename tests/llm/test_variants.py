"""Spelling variants: crc32, index and search schemes, forms and roots against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sheetgrid.llm import variants
from tests.llm.conftest import rows_of

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(rows, least_count):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least_count}
    form, near = {}, {}
    for w in n:
        near[w] = [x for x in n if one_apart(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def mangled(rng, word, letters):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


def vocabulary(seed, stems, letters):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randrange(6, 14))) for _ in range(stems)}
    for _ in range(2):
        words |= {mangled(rng, w, letters) for w in list(words)}
    return sorted(w for w in words if len(w) >= 6)


def test_crc32_side_by_side():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 31, 32, 33, 200]))) for _ in range(500)]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    heads = np.array([zlib.crc32(b"%d:" % i) for i in range(500)], dtype=np.uint32)
    got = variants.crcs(data, ends - [len(w) for w in words], ends, heads)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + w) for i, w in enumerate(words)]


@pytest.mark.parametrize("letters", ["ab", "abcéÿz"])
def test_search_schemes(letters):
    words = vocabulary(2, 60, letters)
    index = variants.Index(words)
    for length in sorted({len(w) for w in words}):
        own = [w for w in words if len(w) == length]
        queries = variants.encode(own).reshape(len(own), length)
        for first in (True, False):
            half = length // 2 if first else length - length // 2
            found = {(own[q], words[w], bool(i)) for q, w, i in zip(*index.near(queries, half, first))}

            def shares(a, b):
                return a[:half] == b[:half] if first else a[-half:] == b[-half:]

            want = {(a, b, len(b) > len(a)) for a in own for b in words if len(b) >= len(a) and one_apart(a, b) and shares(a, b)}
            assert found == want
    for alone in (["abcdef"], ["abcdef", "abcdeg"]):
        assert len(variants.Index(alone).near(variants.encode(["abcdef"]).reshape(1, 6), 3, True)[0]) == len(alone) - 1


@pytest.mark.parametrize("block_words", [20_000, 40])
def test_equals_brute_force(spark, block_words):
    rng = random.Random(7)
    words = vocabulary(4, 120, "abcdeé") + [w + "tion" for w in vocabulary(5, 60, "abc")]  # a crowded half
    rows = []
    for i in range(400):
        chosen = rng.choices(words, weights=[1 / (1 + k % 37) ** 2 for k in range(len(words))], k=120)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in chosen)))
    rows += [(1000 + i, "chained " * 5**i + "chaineds " * 5 ** max(0, i - 1)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(variants.group_variants(docs, least_count=3, block_words=block_words), *COLUMNS)
    assert got == brute(rows, 3)
    assert any(r[1] for r in got)


def test_roots(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(26)] + [("x", "y")]
    found = dict(rows_of(variants.roots(spark.createDataFrame(chain, "word string, form string")), "word", "root"))
    assert found == {f"w{i}": "w26" for i in range(26)} | {"x": "y"}


def test_awkward_rows(spark, awkward, nothing):
    assert variants.group_variants(nothing).count() == 0
    long = "ab" * 400
    more = spark.createDataFrame([(i, f"{long} {long}x {long[1:]} Épsilon Épsilons") for i in range(9)], "doc_id long, text string")
    docs = awkward.unionByName(more, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for least_count in (1, 3):
        assert rows_of(variants.group_variants(docs, least_count=least_count), *COLUMNS) == brute(rows, least_count)
