"""What the physical plans must and must not hold."""

from pyspark.sql import functions as F

from sheetgrid.operators import extract as ex
from sheetgrid.operators.grid import find_anchor, slice_range
from sheetgrid.plans.rules import BUILT_IN, SALES
from workload import extraction, grids, quality
from workload.data import FORMS, form_grid

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bronze(spark, tmp_path):
    path = str(tmp_path / "bronze")
    form_grid(spark, SF, FORMS["sales"]).write.parquet(path)
    return spark.read.parquet(path)


def test_looking_along_a_row_needs_no_shuffle(spark, tmp_path):
    grid = bronze(spark, tmp_path)
    for df in (ex.near(grid, ["FECHA"]), ex.self_cells(grid, ["FECHA"]), ex.extract(grid, [SALES]).records):
        assert "Exchange" not in plan(df) and "Join" not in plan(df)


def test_row_bounds_reach_the_scan(spark, tmp_path):
    grid = bronze(spark, tmp_path)
    for df in (find_anchor(grid, ["FECHA"]), slice_range(grid, 2, 5), ex.self_cells(grid, ["x"], max_row=10)):
        assert "LessThan" in plan(df).split("PushedFilters:")[1].split("]")[0]


def test_blocks_do_not_read_cells(spark, tmp_path):
    from sheetgrid.functions.blocks import sheet_blocks

    schema = plan(sheet_blocks(bronze(spark, tmp_path))).split("ReadSchema:")[1].split(">")[0]
    assert "cells" not in schema


def test_no_query_plans_a_product_of_rows(spark):
    lazy = {**extraction.QUERIES, **grids.QUERIES, **quality.QUERIES}
    for name, query in lazy.items():
        text = plan(query(spark, SF))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_nothing_is_broadcast_without_a_size_check(spark, tmp_path):
    """With no static estimate below the limit, joins shuffle on spread keys."""
    grid = bronze(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        routes = grid.select("source_file").distinct().withColumn("template", F.lit("sales"))
        for df in (ex.below(grid, ["FECHA"]), ex.extract(grid, BUILT_IN, routes).records):
            assert "BroadcastExchange" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_templates_are_read_without_a_join(spark, tmp_path):
    from sheetgrid.sources.workbooks import open_parsed, parse_workbooks, write_parsed
    from workload.data import pack_workbooks

    store = str(tmp_path / "store")
    write_parsed(parse_workbooks(pack_workbooks(form_grid(spark, SF, FORMS["quotation"]))), store)
    books = open_parsed(spark, store)
    text = plan(ex.extract(books.grid, [SALES]).records)
    assert "Join" not in text and "template#" in text.split("PartitionFilters:")[1].split("]")[0]
    assert ex.extract(books.grid, BUILT_IN, sheets=books.sheets).records.count() > 0


def test_maps_are_made_of_rows_found_after_the_anchor(spark, tmp_path):
    text = plan(ex.after(bronze(spark, tmp_path), ["FECHA"]))
    assert text.index("map_from_entries") < text.index("Join")


def test_cells_are_unpacked_below_labels_only(spark, tmp_path):
    """Whole rows meet the columns with labels; cells are keyed by the labels' block, too."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(ex.below(bronze(spark, tmp_path), ["FECHA"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line for line in text.splitlines() if "Join" in line]
    assert "_from" in lines[0] and "col" in lines[0]
    unpack = next(line for line in text.splitlines() if "Generate" in line and "_spots" in line)
    assert text.index(lines[0]) < text.index(unpack) < text.index(lines[1])


def rows_scanned(df):
    """Rows that the scans of a DataFrame hand on, after skipped files, row groups and pages."""
    seen = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = seen.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def clustered(spark, tmp_path):
    """Three of ten rows are of one sheet, the others of 200 files; parsed in no order."""
    from sheetgrid.sinks.parquet import write_clustered

    grid = spark.range(60_000).repartition(8).select(
        F.when(F.col("id") % 10 < 3, "hot.xlsx").otherwise(F.format_string("f%03d.xlsx", F.col("id") % 200)).alias("source_file"),
        F.lit("S").alias("sheet_name"),
        F.col("id").alias("row"),
        F.expr("array(named_struct('col', 0, 'cell_type', 'string', 'value', cast(id AS string)))").alias("cells"),
    )
    grid.write.parquet(str(tmp_path / "as_parsed"))
    stored = spark.read.parquet(str(tmp_path / "as_parsed"))
    write_clustered(stored, str(tmp_path / "clustered"), ["source_file", "sheet_name", "row"], ["source_file"], 1_000)
    return stored, spark.read.parquet(str(tmp_path / "clustered"))


def test_a_range_of_one_file_reads_its_row_groups(spark, tmp_path):
    before, after = clustered(spark, tmp_path)
    assert after.count() == before.count() == 60_000
    for file, low, high in (("f007.xlsx", 0, 60_000), ("hot.xlsx", 30_000, 31_000)):
        found = []
        for grid in (before, after):
            part = slice_range(grid.where(F.col("source_file") == file), low, high)
            found.append((sorted(r["row"] for r in part.select("row").collect()), rows_scanned(part)))
        assert found[0][0] == found[1][0] and found[0][0]
        assert found[1][1] <= len(found[1][0]) + 2 * 1_000 < found[0][1]  # its own groups and two that it shares


def test_a_hot_sheet_is_cut_into_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows would be one file
    try:
        _, after = clustered(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = after.where("source_file = 'hot.xlsx'").select("_metadata.file_path").distinct().count()
    assert files >= 2


def test_clustered_bronze_reads_the_same(spark, tmp_path):
    from sheetgrid.sources.workbooks import cluster_parsed, open_parsed, parse_workbooks, write_parsed
    from workload.data import pack_workbooks

    plain, ordered = str(tmp_path / "plain"), str(tmp_path / "ordered")
    write_parsed(parse_workbooks(pack_workbooks(form_grid(spark, SF, FORMS["quotation"]))), plain)
    cluster_parsed(spark, plain, ordered, row_group_size=100)
    kinds = [[sorted(str(r.asDict(True)) for r in df.collect()) for df in open_parsed(spark, p)] for p in (plain, ordered)]
    assert kinds[0] == kinds[1] and all(kinds[0])
    one = open_parsed(spark, ordered).grid.where("template = 'quotation'")
    name = one.first()["source_file"]
    part = one.where(F.col("source_file") == name)
    assert rows_scanned(part) <= part.count() + 200 < one.count()


def test_first_cells_are_cut_before_they_move(spark, tmp_path):
    from sheetgrid.operators.quality import detect_cell_types, first_cells

    grid = bronze(spark, tmp_path)
    for df in (first_cells(grid, 100), detect_cell_types(grid, 100)):
        text = plan(df)
        assert text.count("Exchange hashpartitioning") == 1
        below = text[text.index("Exchange hashpartitioning"):]
        assert "WindowGroupLimit" in below and "Partial" in below
