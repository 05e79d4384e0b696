"""View existing data as a grid, and convert between grid rows and cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetgrid.functions.plans import pin_cells
from sheetgrid.model import (
    BOOLEAN,
    CELL,
    DATETIME,
    NUMBER,
    SHEET_KEYS,
    STRING,
)


def _as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_to_grid(
    df: DataFrame,
    text: str,
    source_file: str | Column,
    sheet_name: str | Column,
    line_sep: str = "\n",
    cell_sep: str = " ",
) -> DataFrame:
    """View a text column as sheets: line = row, token = column.

    Separators are literal text. Empty tokens are empty cells and lines without
    a token are empty rows. Narrow: no shuffle.
    """
    lines = df.select(
        _as_column(source_file).cast("string").alias("source_file"),
        _as_column(sheet_name).cast("string").alias("sheet_name"),
        F.posexplode(F.split(F.col(text), _quote(line_sep), -1)).alias("row", "_line"),
    ).where(F.replace(F.col("_line"), F.lit(cell_sep), F.lit("")) != "")
    tokens = F.transform(
        F.split(F.col("_line"), _quote(cell_sep), -1),
        lambda v, i: F.struct(
            i.cast("int").alias("col"), F.lit(STRING).alias("cell_type"), v.alias("value")
        ),
    )
    filled = F.filter(tokens, lambda c: c["value"] != "")
    return lines.select(
        *SHEET_KEYS,
        F.col("row").cast("long").alias("row"),
        filled.alias("cells"),
    )


def _quote(sep: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|" else c for c in sep)


def _cell_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.NumericType):
        return NUMBER
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return STRING


def _cell_text(name: str, data_type: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(data_type, T.BooleanType):
        return F.initcap(column.cast("string"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    if isinstance(data_type, T.FloatType | T.DoubleType):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return (
            F.when(F.isnan(column), None)
            .when(whole, column.cast("long").cast("string"))
            .otherwise(column.cast("string"))
        )
    return column.cast("string")


def make_row(cells: Sequence[Column]) -> Column:
    """Array of cell structs without the empty ones (null or '' text)."""
    return F.filter(F.array(*cells), lambda c: c["value"].isNotNull() & (c["value"] != ""))


def make_cell(col: int, value: Column, cell_type: str = STRING) -> Column:
    return F.struct(
        F.lit(col).cast("int").alias("col"),
        F.lit(cell_type).alias("cell_type"),
        value.cast("string").alias("value"),
    )


def table_to_grid(
    df: DataFrame,
    source_file: str | Column,
    sheet_name: str | Column,
    row: str | Column,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """View a table as sheets: record = row (numbered by `row`), field = column."""
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = [
        make_cell(i, _cell_text(c, types[c]), _cell_type(types[c]))
        for i, c in enumerate(columns)
    ]
    return df.select(
        _as_column(source_file).cast("string").alias("source_file"),
        _as_column(sheet_name).cast("string").alias("sheet_name"),
        _as_column(row).cast("long").alias("row"),
        make_row(cells).alias("cells"),
    ).where(F.size("cells") > 0)


def grid_to_cells(grid: DataFrame) -> DataFrame:
    """One record per non-empty cell. Narrow."""
    return pin_cells(grid).select(*SHEET_KEYS, "row", F.inline("cells"))


def cells_to_grid(cells: DataFrame) -> DataFrame:
    """Gather cells into grid rows; a group is one sheet row, never a sheet."""
    return (
        cells.where(F.col("value").isNotNull())
        .groupBy(*SHEET_KEYS, F.col("row").cast("long").alias("row"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(F.col("col").cast("int").alias("col"), "cell_type", "value")
                )
            ).cast(T.ArrayType(CELL)).alias("cells")
        )
    )
