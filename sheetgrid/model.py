"""Data model: one distributed table of sheet rows.

A *grid* holds one record per non-empty sheet row of every workbook (or of any
table or text corpus viewed as sheets)::

    source_file  sheet_name  row  cells: array<struct<col, cell_type, value>>

Positions are 0-based and `cells` is ordered by `col`; an empty cell is absent,
a whitespace-only text cell is present. Keeping a row together means everything
that looks sideways along a row (neighbours, header names, sparse records) is a
narrow transformation; only operators that look down a sheet need a shuffle.
"""

from __future__ import annotations

from pyspark.sql import types as T

SHEET_KEYS = ["source_file", "sheet_name"]

CELL = T.StructType(
    [
        T.StructField("col", T.IntegerType()),
        T.StructField("cell_type", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

GRID_SCHEMA = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("cells", T.ArrayType(CELL)),
    ]
)

SHEETS_SCHEMA = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("sheet_index", T.IntegerType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_cols", T.IntegerType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

STATUS_SCHEMA = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

# Values of cell_type.
STRING, NUMBER, BOOLEAN, DATETIME = "string", "number", "boolean", "datetime"

# Rows per block when the rows of a sheet are spread over tasks. A sheet that
# holds a third of all rows becomes many (sheet, block) keys of this size; a
# sheet smaller than a block stays one key.
BLOCK_ROWS = 65536
