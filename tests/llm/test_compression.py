"""Quality by compression: held-out accuracy on planted junk, evidence by hand, labels untouched by scores."""

import random

import numpy as np
import pytest
import zstandard

from sheetgrid.llm import compression
from tests.llm.conftest import rows_of

STEMS = "lor ip dol sit am con sec tet adi pis cing el sed do eius mod tem por inci di dunt ut lab".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(STEMS, k=rng.randrange(1, 4))) for _ in range(n))


def junk(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in prose(rng, n).split())
    if kind == 1:
        return (prose(rng, 1) + " ") * n
    return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, n).split())


def corpus(seed, n):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        good = int(i % 4 != 0)
        docs.append((seed * 10_000 + i, (prose if good else junk)(rng, rng.randrange(30, 400)), good))
    return docs


def frames(spark, seen, unseen):
    docs = spark.createDataFrame([d[:2] for d in seen + unseen], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in seen], "doc_id long, quality int")


def test_held_out_accuracy(spark):
    seen, unseen = corpus(1, 500), corpus(2, 400)
    docs, labels = frames(spark, seen, unseen)
    got = {r["doc_id"]: r for r in compression.score(docs, labels).collect()}
    assert len(got) == 900
    caught = sum(1 - got[i]["predicted"] for i, _, y in unseen if not y)
    wrong = sum(1 - got[i]["predicted"] for i, _, y in unseen if y)
    assert caught >= 95 and wrong <= 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    good = [got[i]["score"] for i, _, y in unseen if y]
    assert abs(np.mean(good) - 1) < 0.1  # calibrated: nearly all of them are good


def test_evidence_by_hand():
    bad, good = (compression.dictionary([s.encode()] * 3) for s in ("BUY!! NOW!! CHEAP!! " * 20, "the quick brown fox jumps over " * 20))
    text = ("the quick brown fox jumps over " * 90).encode()
    plain = []
    for d in (bad, good):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        plain.append(sum(len(c.compress(text[i : i + 1024])) for i in range(0, len(text), 1024)))
    x = compression.Sizes((bad, good)).evidence(text)
    assert x == pytest.approx(((plain[0] - plain[1]) / max(plain), plain[0] / len(text), plain[1] / len(text)))
    assert x[0] > 0 > compression.Sizes((bad, good)).evidence(b"BUY!! NOW!! CHEAP!! ")[0]
    assert compression.Sizes((b"", b"")).evidence(text)[0] == 0


def test_logistic_recovers_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(2.0, 3.0, (20_000, 2))
    y = (rng.random(20_000) < compression.probability(x, np.array([0.8, -0.5, 0.3]))).astype(float)
    assert compression.logistic(x, y, ridge=1e-9) == pytest.approx([0.8, -0.5, 0.3], abs=0.08)


def test_end_of_a_long_text_counts(spark):
    seen = corpus(3, 300)
    rng = random.Random(9)
    long = [(1, prose(rng, 2000), 1), (2, prose(rng, 400) + " " + junk(random.Random(1), 60_000), 0)]
    docs, labels = frames(spark, seen, long)
    got = {r["doc_id"]: r["predicted"] for r in compression.score(docs, labels).collect()}
    assert (got[1], got[2]) == (1, 0)


def test_labels_and_names_are_no_input(spark):
    seen, unseen = corpus(4, 200), corpus(5, 40)
    docs, labels = frames(spark, seen, unseen)
    moved = docs.selectExpr("doc_id", "text", "CAST(doc_id % 3 AS STRING) AS lang", "'x' AS score", "1 AS good", "2 AS half")
    first, again = (rows_of(compression.score(d, labels), "doc_id", "score", "predicted") for d in (docs, moved.repartition(7)))
    assert first == again
    copies = spark.createDataFrame([(90_000 + i, t) for i, t, _ in unseen], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in compression.score(docs.unionByName(copies), labels).collect()}
    assert all(scores[i] == scores[90_000 + k] for k, _, _ in unseen for i in (k,))


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (7, 0), (None, 1), (99, 0), (2, 5)], "doc_id long, quality int")
    got = compression.score(awkward, labels)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == awkward.count()
    empty = {r["score"] for r in got.collect() if r["doc_id"] in (2, 3)}
    assert len(empty) == 1
    assert compression.score(nothing, labels).count() == 0
    for some in (labels.where("false"), labels.where("doc_id = 5")):
        assert {r["score"] for r in compression.score(awkward, some).collect()} == {0.5}
