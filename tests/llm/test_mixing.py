"""Mixing: targets by repeated resharing, budgets by exhaustive search."""

import itertools
import random

import pytest

from sheetgrid.llm import mixing
from tests.llm.conftest import rows_of


def reshared(sizes, weights, share=1.5, most=2.0):
    """Targets by the definition: share by weight, cut at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, full, left = set(names), {}, share * sum(sizes.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > most * sizes[s]}
        if not over:
            return full | {s: rate * weight[s] for s in open_}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]
        open_ -= over
    return full


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "ü", "zz", "z"][: rng.randrange(1, 9)]
    sizes = {s: rng.choice([0, 1, 50, 1000, 10**6]) for s in names}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(reshared(sizes, (5, 2, 1)))


@pytest.mark.parametrize("seed", range(30))
def test_budget_is_met_as_nearly_as_any_choice_can(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 7, 7, 11, 20, 33, 100]) for _ in range(rng.randrange(1, 9))]
    counts = {n: lengths.count(n) for n in lengths}
    budget = rng.randrange(0, sum(lengths) + 5)
    take = mixing.fit_budget(counts, budget)
    assert all(0 < k <= counts[n] for n, k in take.items())
    best = min(abs(min(budget, sum(lengths)) - sum(c)) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k))
    # The proportional share may commit a few documents first; what remains is exact.
    got = abs(min(budget, sum(lengths)) - sum(n * k for n, k in take.items()))
    assert got <= best + max(lengths) // 2
    if len(lengths) == len(set(lengths)):  # one document each: nothing is committed beforehand
        assert got == best


def test_large_budget_is_exact():
    rng = random.Random(9)
    counts = {n: rng.randrange(1, 2000) for n in range(5, 3000)}
    total = sum(n * c for n, c in counts.items())
    for budget in (1234567, total // 2, total - 17):
        assert sum(n * k for n, k in mixing.fit_budget(counts, budget).items()) == budget


def test_mix_and_reruns(spark):
    rng = random.Random(10)
    docs = [(i, " ".join("w" * rng.randrange(1, 60)), rng.choice([None, "a", "b", "c", "d"])) for i in range(400)]
    docs = [(i, " ".join(["w"] * rng.randrange(0, 60)), s) for i, _, s in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 400
    sizes = {i: len((t or "").split()) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    for s in set(source.values()):
        rows = [r for r in got if source[r["doc_id"]] == s]
        assert {r["source_size"] for r in rows} == {sum(sizes[r["doc_id"]] for r in rows)}
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    again = mixing.mix(df.repartition(7))
    assert rows_of(again, "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in got), key=repr)
    taken = mixing.mixed(df, mixing.mix(df))
    words = {i: 0 for i in sizes}
    for r in taken.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {r["doc_id"]: r["taken"] for r in got}


def test_awkward_rows(awkward, nothing):
    got = rows_of(mixing.mix(awkward), "doc_id", "size")
    assert got == sorted([(1, 10), (1, 10), (2, 0), (3, 0), (4, 0), (None, 10), (5, 3000), (6, 3000), (7, 1), (7, 2)], key=repr)
    assert mixing.mix(nothing).collect() == []
    assert mixing.mixed(awkward, mixing.mix(awkward)).columns == awkward.columns
