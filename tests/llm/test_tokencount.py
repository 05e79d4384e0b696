"""Token counts against a dynamic program per word."""

import random

import public_tokenizers

from sheetgrid.llm import tokencount
from tests.llm.conftest import rows_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(model, word):
    text = tokencount.MARK + word
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(end):
            piece = text[begin:end]
            if piece in model.scores:
                here = (best[begin][0] + model.scores[piece], best[begin][1] - 1)
            elif end - begin == 1:
                size = len(piece.encode())
                here = (best[begin][0] + size * model.rarest, best[begin][1] - size)
            else:
                continue
            best[end] = here if best[end] is None else max(best[end], here)
    return -best[-1][1]


def test_same_counts_as_word_by_word(spark, monkeypatch):
    model = tokencount.Unigram.of_model(PATH)
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeéñ🙂ßth") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    docs = [(i, "\t".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    got = tokencount.count_tokens(spark.createDataFrame(docs, "doc_id long, text string"), PATH)
    want = sorted(((i, len(t.split()), len(set(t.split())), sum(brute(model, w) for w in t.split())) for i, t in docs), key=repr)
    assert rows_of(got, "doc_id", "n_pretokens", "n_distinct", "n_tokens") == want


def test_a_shared_prefix_is_computed_once(monkeypatch):
    model = tokencount.Unigram({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -1.5, "▁a": -1.2})
    steps = []
    step = tokencount.Unigram.step
    monkeypatch.setattr(tokencount.Unigram, "step", lambda self, text, end, best: steps.append(text[:end]) or step(self, text, end, best))
    words = ["aab", "aaba", "aabb", "b", "abab"]
    assert model.terminals(words) == {w: brute(model, w) for w in words}
    assert len(steps) == len(set(steps)) == len({(tokencount.MARK + w)[:k] for w in words for k in range(1, len(w) + 2)})


def test_forgetting_does_not_change_counts(spark, monkeypatch):
    import pyarrow as pa

    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["some words here", "more words", None]})
    tokencount._known.pop(PATH, None), tokencount._models.pop(PATH, None)
    once = [b.to_pydict() for b in tokencount._counts([docs, docs], PATH)]
    monkeypatch.setattr(tokencount, "_REMEMBERED", 0)
    assert [b.to_pydict() for b in tokencount._counts([docs, docs], PATH)] == once


def test_awkward_rows(awkward, nothing):
    got = rows_of(tokencount.count_tokens(awkward, PATH), "doc_id", "n_pretokens", "n_distinct")
    assert got == sorted([(1, 10, 10)] * 2 + [(2, 0, 0), (3, 0, 0), (4, 0, 0), (None, 10, 10), (5, 3000, 3000), (6, 3000, 3000), (7, 1, 1), (7, 2, 2)], key=repr)
    assert tokencount.count_tokens(nothing, PATH).collect() == []
