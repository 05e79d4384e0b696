"""The pipeline's stages against their definitions, each on its own input."""

from collections import Counter

import corpus_pipeline
from sheetgrid.llm import minhash, mixing, quality, secrets
from sheetgrid.llm.common import stored
from tests.llm.conftest import rows_of
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near dedup", "secret scan", "mixing", "packing"]
    results = []
    for _, stage in corpus_pipeline.STAGES:
        results.append(stored(stage(spark, results[-1] if results else docs, SF)))
    assert all(r.columns == docs.columns for r in results[:-1])
    ruled, single, masked, mixed, packed = results

    kept = {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    assert rows_of(ruled, *docs.columns) == [r for r in rows_of(docs, *docs.columns) if r[0] in kept]

    groups = {r["component_id"] for r in minhash.near_duplicates(ruled).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(groups)
    assert set(rows_of(single, *docs.columns)) <= set(rows_of(ruled, *docs.columns))

    before = {r["doc_id"]: r for r in single.collect()}
    after = {r["doc_id"]: r for r in masked.collect()}
    assert before.keys() == after.keys()
    for i, r in before.items():
        assert after[i]["n_chars"] == len(after[i]["text"])
        assert (after[i]["text"] == r["text"]) == (secrets.MASK not in after[i]["text"])
        if 'token = "' in r["text"].lower():
            assert secrets.MASK in after[i]["text"]

    size = lambda t: len((t or "").encode().split())
    aims = {r["source"]: r for r in mixing.mix(masked).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += size(r["text"])
    longest = Counter()
    for r in masked.collect():
        longest[r["source"]] = max(longest[r["source"]], size(r["text"]))
    # A source of a few long documents has no subset closer than half of one.
    assert all(abs(words[s] - r["target"]) <= max(1, longest[s] / 2) for s, r in aims.items())
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2

    padding, tokens = check(packed.collect(), [(r["doc_id"], r["text"]) for r in mixed.collect()])
    assert padding < 0.05 * tokens
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_awkward_rows(spark, awkward, nothing):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, nothing, SF).collect()
        stage(spark, awkward, SF).collect()
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == awkward.columns
            docs = stored(docs)
        if name == "near dedup":
            assert sorted((r["doc_id"] for r in docs.collect()), key=repr) == [1, 5, None]
