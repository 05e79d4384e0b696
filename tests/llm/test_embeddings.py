"""Embedding near-dedup against brute force over all pairs."""

import math

import numpy as np

from sheetgrid.llm import embeddings
from tests.llm.conftest import rows_of


def brute(rows, cosine=0.9):
    vecs = {}
    for i, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vecs[i] = embeddings.unit_rows(np.array([v], dtype=float))[0] if ok else None
    ids = sorted(vecs)
    links = {i: set() for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = vecs[a], vecs[b]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= cosine:
                links[a].add(b)
                links[b].add(a)
    component = {}
    for i in ids:
        if i not in component:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in component:
                    component[k] = i
                    todo += links[k]
    return sorted(((i, len(links[i]), component[i], component[i] == i) for i in ids), key=repr)


def test_same_links_as_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        centre = rng.standard_normal(24)
        rows.append(centre)
        for _ in range(int(rng.integers(0, 5))):
            rows.append(centre + 0.05 * rng.standard_normal(24))
    # A chain: neighbours are linked, ends are not, so the component is wider than the core.
    for angle in np.arange(0, 1.5, 0.2):
        v = np.zeros(24)
        v[0], v[1] = math.cos(angle), math.sin(angle)
        rows += [v, v * 1e200, v * 1e-200]
    order = rng.permutation(len(rows))
    data = [(int(i), [float(x) for x in rows[k]]) for i, k in enumerate(order)]
    data += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [1.0, None]), (1005, [1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = embeddings.near_vectors(df)
    assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == brute(data)


def test_large_component_is_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(5)
    wide = rng.standard_normal(16)
    data = []
    for i in range(150):
        data.append((i, (wide / np.linalg.norm(wide) + rng.standard_normal(16) * 0.07).astype("float32").tolist()))
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    want = brute(data)
    got = rows_of(embeddings.near_vectors(df), "vec_id", "n_links", "component_id", "kept")
    assert got == want
    assert len({n for _, n, _, _ in want}) > 3


def test_recall_at_the_threshold_does_not_fall_with_size():
    for n in (10, 10**4, 10**9):
        passes = embeddings.passes_needed(n)
        agree = (1 - math.acos(0.9) / math.pi) ** max(0.0, math.log2(n / embeddings.WINDOW))
        assert agree >= 1 or (1 - agree) ** passes <= 0.0101


def test_recall_where_a_third_of_the_rows_is_crowded(spark):
    rng = np.random.default_rng(6)

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    n, dims = 2400, 256
    spread = unit(rng.standard_normal((n, dims)))
    middle = unit(rng.standard_normal(dims))
    cone = math.sqrt(0.83) * middle + math.sqrt(0.17) * unit(rng.standard_normal((n // 3, dims)))
    spread[: n // 3] = unit(cone)
    for i in range(0, 400, 2):  # pairs of cosine 0.905 inside the cone
        other = unit(spread[i + 1] - (spread[i + 1] @ spread[i]) * spread[i])
        spread[i + 1] = 0.905 * spread[i] + math.sqrt(1 - 0.905**2) * other
    data = [(i, v.tolist()) for i, v in enumerate(spread)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    want = dict((i, c) for i, _, c, _ in brute_fast(spread))
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_vectors(df, window=8).collect()}
    pairs = [i for i in want if want[i] != i]
    assert len(pairs) >= 200
    assert sum(got[i] == want[i] for i in pairs) >= 0.98 * len(pairs)
    assert all(got[i] in (i, want[i]) for i in want)


def brute_fast(units):
    near = units @ units.T >= 0.9
    label = np.arange(len(units))
    for _ in range(len(units)):
        new = np.where(near, label[None, :], len(units)).min(axis=1)
        if (new == label).all():
            break
        label = new
    return [(i, int(near[i].sum()) - 1, int(label[i]), label[i] == i) for i in range(len(units))]


def test_awkward_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 1), (2, None, None), (3, [1.0, 2.0], 5)]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "label AS a", "label AS b", "label AS dims")
    got = rows_of(embeddings.near_vectors(df), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True), (2, 0, 2, True), (3, 2, 1, False)], key=repr)
    assert embeddings.near_vectors(df.where("false")).collect() == []
