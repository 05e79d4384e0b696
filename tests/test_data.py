"""Files written for the folder queries."""

import pytest

from workload.data import write_files

FILES = [("a.xlsx", b"\0\1\xff"), ("b c.xlsx", b"2")]


@pytest.mark.parametrize("base", ["{}", "file:{}", "file://{}", "viewfs://store{}"])
def test_files_land_wherever_spark_writes_on_a_cluster(spark, tmp_path, monkeypatch, base):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.store.link.{tmp_path}", f"file://{tmp_path}")
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[2,1,1024]")
    files = spark.createDataFrame(FILES, "path string, content binary")
    for _ in range(2):
        write_files(files, f"{base.format(tmp_path)}/two words/in")
    landed = {p.name: p.read_bytes() for p in (tmp_path / "two words/in").iterdir()}
    assert landed == dict(FILES)


def test_a_folder_that_a_task_does_not_see_is_an_error(spark, tmp_path):
    from pyspark.sql import functions as F

    def gone(name):
        (tmp_path / "in").rmdir()  # as on a machine that does not share it
        return name

    files = spark.createDataFrame(FILES[:1], "path string, content binary")
    with pytest.raises(Exception, match="No such file"):
        write_files(files.withColumn("path", F.udf(gone)("path")), str(tmp_path / "in"))
