"""Source divergence: pointer sort against Python's sort, the audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from sheetgrid.llm import divergence, pointers
from tests.llm.conftest import rows_of

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute(rows, least, top):
    docs = [(lang or "", source or "", text or "") for lang, source, text in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        n[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    groups = sorted({(lang, source) for lang, source, _ in docs})
    for lang, source in groups:
        kept = [t for t, k in df[lang].items() if k >= least]
        whole = Counter()
        for other, s in groups:
            if other == lang:
                whole.update(n[lang, s])

        def share(counts, t):
            return 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept))

        own = n[lang, source]
        pairs = [
            (s, sum(abs(share(own, t) - share(n[lang, s], t)) for t in kept)) for other, s in groups if other == lang and s != source
        ]
        terms = [(t, share(own, t) - share(whole, t)) for t in kept if own[t] > 0 and share(own, t) > share(whole, t)]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out, key=repr)


def test_sort_of_pointers():
    rng = random.Random(3)
    stems = ["", "a", "ab", "abcdefgh", "abcdefghi", "zz", "é" * 9, "abcdefgh" * 3]
    texts = [rng.choice(stems) + rng.choice(stems) for _ in range(700)] + ["x" * 5000] * 3
    column = pa.array(texts)
    (first, last, data, offsets), *rest = pointers.shards(column)
    assert (first, last, rest) == (0, len(texts), [])
    words = pointers.Words(data, offsets[:-1], offsets[1:])
    for short in (1, 10, 1 << 16):
        order, new = pointers.sort(words, short)
        assert order.tolist() == sorted(range(len(texts)), key=lambda i: (texts[i].encode(), i))
        runs = np.split(order, np.flatnonzero(new)[1:])
        assert [{texts[i] for i in run} for run in runs] == [{t} for t in sorted(set(texts), key=str.encode)]
        assert words.strings(order).to_pylist() == [texts[i] for i in order]


def test_shards_split_between_texts_only():
    texts = pa.array(["ab CD", None, "e" * 50, "", "f g"])
    found = [
        (first, rows.tolist(), [data[a:b].tobytes() for a, b in zip(starts, ends)])
        for first, _, data, offsets in pointers.shards(texts, limit=8)
        for starts, ends, rows in [pointers.slices(divergence._INSIDE[data], offsets)]
    ]
    assert found == [(0, [0, 0], [b"ab", b"cd"]), (2, [0], [b"e" * 50]), (3, [1, 1], [b"f", b"g"])]


def test_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["Alpha", "BETA", "gamma2delta", "é", "Élan", "ÿ\x7fx", "z" * 40, "l'eau", "日本", "x_y"]
    rows = [
        (rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S2", "é", None, ""]), " ".join(rng.choices(words, k=rng.randrange(9))))
        for _ in range(300)
    ]
    rows += [("de", "only", "one two"), ("it", "a", None), ("it", "b", ""), ("en", "hot", "zebra " * 5000)]
    rows += [("en", "copy", "alpha beta")] * 120
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for least, tile, block in ((2, 256, 1024), (30, 2, 3), (10**6, 2, 3)):
        assert rows_of(divergence.audit(docs, least, 4, tile, block), *COLUMNS) == brute(rows, least, 4)


def test_awkward_rows(spark, awkward, nothing):
    assert divergence.audit(nothing).count() == 0
    rows = [(r["lang"], r["source"], r["text"]) for r in awkward.collect()]
    assert rows_of(divergence.audit(awkward, least=1), *COLUMNS) == brute(rows, 1, 50)
