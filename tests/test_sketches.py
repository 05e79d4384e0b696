"""Profiles by sketches: exact counts, error bounds, and files read once."""

import os

import pytest
from pyspark.sql import functions as F

from sheetgrid.operators.quality import profile
from sheetgrid.operators.sketches import describe, merge_sketches, sketch, update_sketches


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(60000).selectExpr(
        "id", "id % 700 AS some", "if(id % 3 = 0, null, double(id * id)) AS squares", "'k' || (id % 20000) AS column_name",
        "if(id < 0, 1, null) AS nothing", "if(id % 2 = 0, double('nan'), 1.5D) AS half", "array(id % 5) AS few", "id % 4 AS part",
    )


def figures(df):
    return {r["column_name"]: r for r in df.collect()}


def test_parts_merge_into_the_whole(spark, numbers):
    whole = figures(describe(sketch(numbers)))
    merged = figures(describe(merge_sketches(sketch(numbers, part=F.col("part")))))
    exact = figures(profile(numbers))
    assert merged.keys() == whole.keys() == exact.keys()
    for name, r in merged.items():
        w = whole[name]
        assert (r["n_rows"], r["null_count"], r["dtype"]) == (60000, exact[name]["null_count"], exact[name]["dtype"])
        assert (r["low"], r["high"]) == (w["low"], w["high"])
        # Four standard errors.
        for got in (r, w):
            assert abs(got["unique_estimate"] - exact[name]["unique_count"]) <= 0.032 * exact[name]["unique_count"]
    for p, q in zip((0.25, 0.5, 0.75), merged["squares"]["quantiles"]):
        assert abs((q**0.5) / 60000 - p) < 0.03
    assert merged["nothing"]["quantiles"] is None and merged["few"]["quantiles"] is None
    assert (merged["half"]["low"], merged["half"]["high"]) == (1.5, 1.5)


def test_only_new_and_changed_files_are_read(spark, tmp_path):
    path, store = tmp_path / "lake a", str(tmp_path / "store")
    path.mkdir()

    def put(name, n, extra="id AS a"):
        spark.range(n).selectExpr("id", extra).toPandas().to_parquet(path / f"{name}.parquet")

    def now():
        return {(r["source_file"].rsplit("/")[-1], r["column_name"]): r["n_rows"] for r in update_sketches(spark, str(path), store).collect()}

    assert now() == {}
    put("a {b}", 10)
    put("c", 20)
    first = now()
    assert first == {("a%20%7Bb%7D.parquet", "id"): 10, ("a%20%7Bb%7D.parquet", "a"): 10, ("c.parquet", "id"): 20, ("c.parquet", "a"): 20}
    runs = lambda: sorted(x for x in os.listdir(f"{store}/manifest") if x.startswith("run"))
    assert now() == first and runs() == ["run=1"]
    put("c", 25, "string(id) AS a")
    put("d", 0)
    with pytest.raises(Exception, match="CANNOT_MERGE_SCHEMAS"):
        now()
    assert runs() == ["run=1"]
    (path / "d.parquet").unlink()
    assert now() == {**first, ("c.parquet", "id"): 25, ("c.parquet", "a"): 25} and runs() == ["run=1", "run=2"]
    again = merge_sketches(update_sketches(spark, str(path), store))
    assert {(r["column_name"], r["dtype"], r["n_rows"]) for r in again.collect()} == {("id", "bigint", 35), ("a", "bigint", 10), ("a", "string", 25)}
    put("d", 0)
    assert now()["c.parquet", "a"] == 25 and runs()[-1] == "run=3"
    (path / "c.parquet").unlink()
    assert now() == {k: v for k, v in first.items() if k[0] != "c.parquet"}


def test_nothing(spark, numbers):
    assert sketch(numbers.where("false")).collect() == []
    assert sketch(numbers.where("false"), part=F.col("part")).collect() == []
    assert describe(merge_sketches(sketch(numbers).where("false"))).collect() == []
