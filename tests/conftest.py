import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def grid(spark):
    """Build a grid from {(file, sheet): {row: [cell, ...]}}; None is an empty cell."""
    from sheetgrid.model import BOOLEAN, GRID_SCHEMA, NUMBER, STRING

    def kind(value):
        if isinstance(value, bool):
            return BOOLEAN
        return NUMBER if isinstance(value, (int, float)) else STRING

    def build(sheets):
        records = []
        for (file, sheet), rows in sheets.items():
            for row, cells in rows.items():
                found = [(i, kind(v), str(v)) for i, v in enumerate(cells) if v is not None]
                if found:
                    records.append((file, sheet, row, found))
        return spark.createDataFrame(records, GRID_SCHEMA)

    return build
