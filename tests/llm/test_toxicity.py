"""Toxicity: decoding, held-out accuracy on planted texts with and without disguise, labels untouched by scores."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from sheetgrid.llm import toxicity
from tests.llm.conftest import rows_of

BAD = ["moron", "idiot", "pathetic", "worthless"]
CLEAN = "the rain in spain stays mainly on a plain and some people read many old books about it with interest model time topic lost trip".split()


def disguise(rng, word):
    kind = rng.randrange(4)
    if kind == 0:
        return word.translate(str.maketrans("oietas", "01374$"))
    if kind == 1:
        return rng.choice([" ", ".", "-"]).join(word)
    if kind == 2:
        at = rng.randrange(len(word))
        return word[:at] + word[at] * 4 + word[at + 1 :]
    return word.upper() + "!!"


def corpus(seed, n, hidden):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(20, 80))]
        if i % 4 == 0:
            for _ in range(3):
                bad = rng.choice(BAD)
                words.insert(rng.randrange(len(words)), disguise(rng, bad) if hidden else bad)
        else:  # digits and signs that are no disguise
            words += rng.sample(["R2D2", "3rd", "$100", "c.a.", "a", "b", "1,000", "x86!!!"], 3)
        docs.append((i + 10_000 * seed, " ".join(words), int(i % 4 == 0)))
    return docs


def test_decoding(spark):
    docs = corpus(1, 400, False)
    model = toxicity.language_model(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"))
    for disguised in ("m0r0n", "M0R0N", "moooooron", "m.o.r.o.n", "moron"):
        assert toxicity.decode(disguised, model)[0] == "moron"
    assert "idiot" in toxicity.decode("1d10t", model)
    assert "worthless" in toxicity.decode("w0rthle$$", model)
    assert toxicity.decode("", model) == [""]
    assert model.shape == (toxicity.CLASSES,) * 2


FORMS = [
    "stupid", "5tup1d", "s t u p i d", "stuuuupid", "st" + "u" * 70 + "pid", "what a s t u p i d man",
    "s t u p i d m o r o n", "m o r o n s t u p i d", "s - t - u - p - i - d", "-".join("abcdefghijklm" * 6 + "stupid"),
    "x" * 10 + "qu" * 40 + "s.t.u.p.1.d", " ".join("notable" * 8 + "stupid" + "notable" * 8), " ".join("ab" * 31 + "stupid" + "ab" * 31),
    "S.T.U.P.I.D", "glued" * 20 + "5tup1d" + "word" * 9,
]


@pytest.mark.parametrize("form", FORMS)
def test_disguises_are_restored(form):
    model = np.log(np.full((toxicity.CLASSES,) * 2, 1 / toxicity.CLASSES))
    word = np.frombuffer(b"stupid stupidity", dtype=np.uint8)
    whole, beginning = toxicity._features(word, np.array([0, 7]), np.array([6, 16]))
    (chunk,) = toxicity.rolling.chunks(pa.array([f"some words before {form} and after"]))
    found = set(toxicity.Restored(chunk, model).hashes.reshape(-1).tolist())
    assert whole[0] in found or beginning[1 + toxicity.PREFIXES.index(6)] in found


def test_decoding_equals_all_paths():
    rng = np.random.default_rng(2)
    model = np.log(rng.dirichlet(np.ones(toxicity.CLASSES), toxicity.CLASSES))

    def weight(path):
        text = "".join(t for t, _ in path)
        kinds = [0, *(toxicity.char_class(c) for c in text), 0]
        return sum(w for _, w in path) + sum(model[a, b] for a, b in zip(kinds, kinds[1:])), text

    for token in ("1d10t", "m0r0n", "$tup1d", "aaab1b", "a.b-c1", "0*1", "|1|1|", "éé1ö"):
        best = max(weight(path) for path in itertools.product(*toxicity.lattice(token)))
        assert toxicity.decode(token, model)[0] == best[1]


def test_held_out_accuracy_behind_disguise(spark):
    seen, unseen = corpus(1, 400, False), corpus(2, 400, True)
    docs = spark.createDataFrame([d[:2] for d in seen + unseen], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in seen], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    caught = sum(got[i]["predicted"] for i, _, y in unseen if y)
    wrong = sum(got[i]["predicted"] for i, _, y in unseen if not y)
    assert caught >= 90 and wrong <= 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_scores_depend_on_the_text_alone(spark):
    docs = corpus(1, 200, False)
    labels = spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int")
    one = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    copies = one.unionByName(one.selectExpr("doc_id + 90000 AS doc_id", "text"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(copies, labels).collect()}
    assert all(got[i] == got[i + 90000] for i, _, _ in docs)


@pytest.mark.parametrize("text", ["a" * 5000, "é" * 3000, "1" * 100, "a b c " * 2000, "!!! ... ???", "\x00\x01", "$", "a1", "x" * 63 + "1"])
def test_any_text_is_restored(text):
    import numpy as np
    import pyarrow as pa

    from sheetgrid.llm import rolling

    model = np.full((toxicity.CLASSES,) * 2, -3.0)
    for c in rolling.chunks(pa.array([text, None, "", text])):
        found = toxicity.Restored(c, model)
        assert len(found.hashes) == len(found.row) == len(found.reading)
        assert (found.hashes[found.row == 0] == found.hashes[found.row == 3]).all()


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (1, 0)], "doc_id long, toxic int")
    got = rows_of(toxicity.score(awkward, labels), "doc_id")
    assert got == sorted([(1,), (1,), (2,), (3,), (4,), (None,), (5,), (6,), (7,), (7,)], key=repr)
    assert {r["score"] for r in toxicity.score(awkward, labels.where("false")).collect()} == {0.0}
    assert toxicity.score(nothing, labels).collect() == []
