from unittest.mock import patch

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader, DataFrameWriter

from sheetgrid.sinks.names import clean_names, prepare_for_db
from sheetgrid.sinks.parquet import compact, merge_parquet, write_parquet
from sheetgrid.sinks.tables import table_info, write_table
from sheetgrid.sources.parquet_files import footer_inventory, parquet_health


def test_prepare_for_db(spark):
    df = spark.sql(
        "SELECT timestamp'2024-01-05 10:00:00' AS `Time Stamp`, true AS `Is-On`, 1 AS `2024 Total`"
    )
    got = prepare_for_db(df)
    assert got.columns == ["time_stamp", "is_on", "col_2024_total"]
    assert tuple(got.first()) == ("2024-01-05 10:00:00", 1, 1)


def test_colliding_names_are_refused():
    with pytest.raises(ValueError, match="a_b"):
        clean_names(["A b", "a-b"])


def test_codecs(spark, tmp_path):
    df = spark.range(10)
    for codec in ("none", "snappy", "gzip", "zstd", "lz4"):
        write_parquet(df, str(tmp_path / codec), codec)
        assert spark.read.parquet(str(tmp_path / codec)).count() == 10
    with pytest.raises(ValueError, match="brotli"):
        write_parquet(df, str(tmp_path / "x"), "brotli")


def test_compact_makes_fewer_files_with_bounded_row_groups(spark, tmp_path):
    spark.range(50_000).repartition(20).write.parquet(str(tmp_path / "small"))
    compact(spark, str(tmp_path / "small"), str(tmp_path / "large"), row_group_size=10_000)
    files = footer_inventory(spark, str(tmp_path / "large")).collect()
    assert sum(f.num_rows for f in files) == 50_000 and len(files) < 20
    assert all(f.num_rows <= f.num_row_groups * 10_000 for f in files)


def test_merge_unions_columns_by_name(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.sql("SELECT 'x' AS s, 9 AS id").write.parquet(str(tmp_path / "b"))
    merge_parquet(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "m"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).select("id", "s").collect()))
    assert got == [(0, None), (1, None), (2, None), (9, "x")]


def test_health_and_footers(spark, tmp_path):
    base = tmp_path / "lake dir 100%+é%20"
    spark.range(5).select("id", F.lit(None).cast("double").alias("v")).coalesce(1).write.parquet(str(base / "good"))
    spark.range(0).select("id").coalesce(1).write.parquet(str(base / "none"))
    nothing = spark.range(3).select(F.lit(None).cast("long").alias("id"), F.lit(float("nan")).alias("v"))
    nothing.coalesce(1).write.parquet(str(base / "nulls"))
    (base / "bad").mkdir()
    (base / "bad" / "x.parquet").write_bytes(b"PAR1 nonsense PAR1")
    kind = F.element_at(F.split("path", "/"), -2)
    got = {
        r.kind: (r.is_readable, r.is_empty, r.is_all_null, r.is_valid)
        for r in parquet_health(spark, str(base)).withColumn("kind", kind).collect()
    }
    assert got == {
        "good": (True, False, False, True),
        "none": (True, True, False, False),
        "nulls": (True, False, True, False),
        "bad": (False, False, False, False),
    }
    footers = {r.kind: r for r in footer_inventory(spark, str(base)).withColumn("kind", kind).collect()}
    assert footers["good"].num_rows == 5 and footers["good"].num_columns == 2
    assert footers["good"].num_row_groups == 1 and "id" in footers["good"].schema
    assert footers["bad"].error and footers["bad"].num_rows is None


def test_catalog_tables_fail_replace_append(spark):
    df = spark.range(3)
    write_table(df, "t_modes", if_exists="fail")
    with pytest.raises(Exception, match="already exists"):
        write_table(df, "t_modes", if_exists="fail")
    write_table(df, "t_modes", if_exists="append")
    assert spark.table("t_modes").count() == 6
    write_table(df, "t_modes")
    assert spark.table("t_modes").count() == 3
    info = table_info(spark, "t_modes").collect()
    assert [tuple(r) for r in info] == [("t_modes", "id", "bigint", False, None, 3)]
    with pytest.raises(ValueError):
        write_table(df, "t_modes", if_exists="merge")


def test_jdbc_options(spark):
    """No database is started; only what is handed to Spark's JDBC writer is checked."""
    with patch.object(DataFrameWriter, "jdbc") as jdbc:
        write_table(spark.range(1), "t", "jdbc:x:y", "append", 500, {"user": "u"})
        write_table(spark.range(1), "t", "jdbc:x:y")
    assert [c.args for c in jdbc.call_args_list] == [
        ("jdbc:x:y", "t", "append", {"batchsize": "500", "user": "u"}),
        ("jdbc:x:y", "t", "overwrite", {"batchsize": "1000"}),
    ]
    with patch.object(DataFrameReader, "jdbc", return_value=spark.range(2)):
        assert table_info(spark, "t", "jdbc:x:y").first().row_count == 2
    with pytest.raises(ValueError):
        write_table(spark.range(1), "t", "sqlite:///x.db")


def test_an_empty_batch_leaves_a_table_of_others_alone(spark):
    from sheetgrid.sinks.tables import write_batch

    df = spark.createDataFrame([(1, "x")], "id int, name string")
    write_table(df, "t_no_batches", if_exists="fail")
    write_batch(df.where("false"), "t_no_batches", "1")
    assert [tuple(r) for r in spark.table("t_no_batches").collect()] == [(1, "x")]
    with pytest.raises(ValueError, match="not written in batches"):
        write_batch(df, "t_no_batches", "1")


def test_a_batch_costs_few_jobs_whatever_the_columns(spark, tmp_path):
    from sheetgrid.sinks.tables import write_batch

    df = spark.range(3).selectExpr("id AS a", *[f"'x' AS c{i}" for i in range(12)])
    write_batch(df, "batch_jobs", "0", path=str(tmp_path / "jobs"))
    spark.sparkContext.setJobGroup("batch_jobs", "")
    try:
        write_batch(df, "batch_jobs", "1")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("batch_jobs")) <= 2
    assert spark.table("batch_jobs").count() == 6
