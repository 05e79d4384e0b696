"""Packing: every id in one piece, gapless sequences, little padding, ids as the library gives them."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sheetgrid.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\na b", "a  b", "a  b", "x  y", "don't  we'll 's", "1 2  33 !? ...  ",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "ünï çödé 日本 語  text", "\x00\x1c \x1f a", "é e", "tab\t tab \tx", "🙂 🙂  🙂" * 3,
]


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def fragments(rng, tokens):
    out = b""
    for token in rng.choices(tokens, k=40):
        at = rng.randrange(len(token))
        out += token[at : at + rng.randrange(1, 9)] if rng.random() < 0.5 else token
    return out.decode("utf-8", "ignore")


def test_ranks_give_the_same_ids():
    rng = random.Random(1)
    encoder = packing.Encoder(PATH)
    tokens = list(encoder.fast._mergeable_ranks)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab é\n\t .'1") for _ in range(200)) for _ in range(50)]
    texts += [fragments(rng, tokens) for _ in range(2000)]
    texts += [" " * 300_000, "x" + "\n \t" * 100_000 + "y", "z" * 50_000, "x " * 6_000]
    texts += ["".join(chr(c) for c in rng.sample(range(0xD800), 300)) for _ in range(100)]
    assert encoder.encode(texts) == [ids_of(t)[:-1].tobytes() for t in texts]
    assert [encoder._taken(t) for t in ("a b", "a<|endoftext|>", " " * 9_999, "a" + " " * 10_000)] == [True, False, True, False]


def test_other_vocabularies_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = packing.Encoder(path), Tokenizer.from_file(path)
    assert encoder.fast is None
    texts = ["Some Words, and more", "", "é 12"]
    assert encoder.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def check(got, docs, window=1024):
    texts = Counter(i for i, _ in docs)
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    padding = tokens = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= window
        tokens += at
        padding += 0 if at & (at - 1) == 0 else window - at
    ids = {}
    for i, t in docs:
        own = ids_of(t)
        ids.setdefault((i, len(own)), []).append(own)
    assert ids.keys() == by_doc.keys()
    for key, rows in by_doc.items():
        copies = len(ids[key])
        want = Counter()
        for own in ids[key]:
            for at in range(0, len(own), window):
                want[at, len(own[at : at + window]), zlib.crc32(own[at : at + window].tobytes())] += 1
        assert Counter((r["start"], r["length"], r["ids_crc32"]) for r in rows) == want, (key, copies)
    assert sum(texts.values()) == sum(len(v) for v in ids.values())
    return padding, tokens


def test_pack(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "Ärger", "x1"]) for _ in range(rng.choice([1, 30, 200, 700, 3000])))) for i in range(300)]
    docs += [(i, t) for i, t in enumerate(ODD, 1000)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()
    padding, tokens = check(got, docs)
    assert padding < 0.05 * tokens


def test_awkward_rows(awkward, nothing):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    check(packing.pack(awkward, PATH).collect(), docs)
    assert packing.pack(nothing, PATH).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_tail_once(seed):
    rng = random.Random(seed)
    histogram = {n: rng.randrange(1, 4000) for n in rng.sample(range(1, 1024), 300)}
    used, total = Counter(), 0
    for pattern, repeats in packing.plan_patterns(histogram, 1024):
        size = sum(n * k for n, k in pattern)
        assert 0 < size <= 1024 and repeats > 0
        total += size * repeats
        for n, k in pattern:
            used[n] += k * repeats
    assert used == Counter(histogram)
    # No two tails over half a window share one.
    least = max(total / 1024, sum(k for n, k in histogram.items() if n > 512))
    assert sum(repeats for _, repeats in packing.plan_patterns(histogram, 1024)) <= 1.08 * least + 1


def test_least_squares_meets_counts():
    combos = packing.combinations(64)
    assert (combos.sum(axis=1) == 64).all()
    want = np.random.default_rng(0).integers(0, 50, len(combos)).astype(float)
    counts = np.zeros(64 + 1)
    for x, combo in zip(want, combos):
        for n in combo[combo > 0]:
            counts[n] += x
    x = packing.solve_counts(counts, combos)
    made = np.zeros_like(counts)
    for y, combo in zip(x, combos):
        for n in combo[combo > 0]:
            made[n] += y
    assert (x >= 0).all() and np.abs(made - counts).max() < 0.02 * counts.max()
