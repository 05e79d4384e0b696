"""Grid queries: views, extents, ranges, headers, cleaning, workbook reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetgrid.model import SHEET_KEYS
from sheetgrid.operators.grid import (
    clean_grid,
    preview,
    promote_header,
    rows_as_maps,
    sheet_dims,
    slice_range,
)
from sheetgrid.operators.tables import clean_table
from sheetgrid.sources.views import (
    cells_to_grid,
    grid_to_cells,
    make_cell,
    make_row,
    table_to_grid,
    text_to_grid,
)
from sheetgrid.sources.workbooks import parse_workbooks, split_parsed
from workload.data import (
    BOM_FORM,
    DOCUMENT_CELLS,
    document_grid,
    form_cells_sql,
    form_grid,
    pack_workbooks,
    table,
)

_documents = f"WITH {DOCUMENT_CELLS}\n"
_bom = f"WITH {form_cells_sql(BOM_FORM)}\n"


def text_cells_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_to_cells(document_grid(spark, sf_dir))
    return cells.groupBy("sheet_name").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum(F.length("value")).alias("n_chars"),
        F.sum(F.col("row") + F.col("col")).alias("position_sum"),
    )


def sheet_dims_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_dims(document_grid(spark, sf_dir))


def sheet_dims_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as workbooks: one sheet per turn."""
    turns = table(spark, sf_dir, "conversations")
    return sheet_dims(text_to_grid(turns, "text", "conv_id", "turn"))


def grid_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(document_grid(spark, sf_dir)).withColumn(
        "preview", F.concat_ws("|", "preview")
    )


def range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_to_cells(slice_range(document_grid(spark, sf_dir), 2, 5, 1, 3)).drop("cell_type")


def range_slice_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_to_cells(slice_range(document_grid(spark, sf_dir), 3, start_col=4)).drop(
        "cell_type"
    )


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]


def part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_to_grid(
        table(spark, sf_dir, "part"), "p_brand", "p_type", "p_partkey", PART_COLUMNS
    )


def table_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_to_cells(part_grid(spark, sf_dir))


def cells_pivot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells back to rows and to the columns of the table they came from."""
    grid = cells_to_grid(grid_to_cells(part_grid(spark, sf_dir)))
    rows = rows_as_maps(grid)
    return rows.select(
        F.col("cells")["col_0"].try_cast("long").alias("p_partkey"),
        F.col("cells")["col_1"].alias("p_name"),
        F.col("cells")["col_2"].alias("p_brand"),
        F.col("cells")["col_3"].alias("p_type"),
        F.col("cells")["col_4"].try_cast("int").alias("p_size"),
    )


def rows_as_maps_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_as_maps(document_grid(spark, sf_dir))
    return rows.select(
        *SHEET_KEYS, "row", F.size("cells").alias("n_keys"), F.col("cells")["col_1"].alias("col_1")
    )


def promote_header_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of each document as header of the lines below."""
    return promote_header(document_grid(spark, sf_dir)).select(
        *SHEET_KEYS, "row", F.explode("fields").alias("name", "value")
    )


def promote_header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promote_header(
        form_grid(spark, sf_dir, BOM_FORM),
        header_row=2,
        skip_rows=[4],
        columns=["Part Number / NP", "Descripción", "Cantidad"],
    ).select(
        *SHEET_KEYS,
        "row",
        F.col("Part Number / NP").alias("part_number"),
        F.col("Descripción").alias("description"),
        F.col("Cantidad").alias("quantity"),
    )


def promote_header_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promote_header(document_grid(spark, sf_dir), header_compat=True).select(
        *SHEET_KEYS, "row", F.explode("fields").alias("name", "value")
    )


def renumber_rows_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_to_cells(clean_grid(form_grid(spark, sf_dir, BOM_FORM))).drop("cell_type")


def clean_rows_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of finished orders only, so other records and one column are empty."""
    done = F.col("o_orderstatus") == "F"
    orders = table(spark, sf_dir, "orders").select(
        F.when(done, F.col("o_orderkey")).alias("o_orderkey"),
        F.when(done, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_totalprice") < 0, F.col("o_custkey")).alias("refunded_to"),
    )
    return clean_table(orders)


def customer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in workbooks of 500 with a headed sheet per market segment."""
    customers = table(spark, sf_dir, "customer").withColumn(
        "book",
        F.concat(
            F.lit("customers_"), F.floor(F.col("c_custkey") / 500).cast("string"), F.lit(".xlsx")
        ),
    )
    rows = table_to_grid(
        customers,
        "book",
        "c_mktsegment",
        F.col("c_custkey") % 500 + 1,
        ["c_custkey", "c_name", "c_nationkey"],
    )
    names = [make_cell(i, F.lit(n)) for i, n in enumerate(("Key", "Name", "Nation"))]
    headers = customers.select("book", "c_mktsegment").distinct().select(
        F.col("book").alias("source_file"),
        F.col("c_mktsegment").alias("sheet_name"),
        F.lit(0).cast("long").alias("row"),
        make_row(names).alias("cells"),
    )
    return headers.unionByName(rows)


def xlsx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written to workbooks and read back from their bytes."""
    books = split_parsed(parse_workbooks(pack_workbooks(customer_blocks(spark, sf_dir))))
    return grid_to_cells(books.grid)


def xlsx_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = split_parsed(parse_workbooks(pack_workbooks(customer_blocks(spark, sf_dir))))
    return books.sheets.drop("template", "ok", "error")


_CUSTOMER_CELLS = """
SELECT 'customers_' || cast(c_custkey // 500 AS varchar) || '.xlsx' AS source_file,
       c_mktsegment AS sheet_name, c_custkey % 500 + 1 AS "row", col, cell_type, value
FROM (SELECT c_custkey, c_mktsegment, 0 AS col, 'number' AS cell_type,
        cast(c_custkey AS varchar) AS value FROM customer
      UNION ALL SELECT c_custkey, c_mktsegment, 1, 'string', c_name FROM customer
      UNION ALL SELECT c_custkey, c_mktsegment, 2, 'number', cast(c_nationkey AS varchar)
        FROM customer)
UNION ALL
SELECT book, c_mktsegment, 0, unnest([0, 1, 2]), 'string', unnest(['Key', 'Name', 'Nation'])
FROM (SELECT DISTINCT 'customers_' || cast(c_custkey // 500 AS varchar) || '.xlsx' AS book,
        c_mktsegment FROM customer)
"""


def _header_sql(header_row: int) -> str:
    """Names of a header row on each cell below.

    A repeat counts the names like it; only where that meets another name are the names of
    the sheet gone through one by one, each taking the first number that is free.
    """
    return f"""
    , spans AS (SELECT source_file, sheet_name, max(col) AS last_col FROM g
                WHERE "row" = {header_row} GROUP BY ALL),
    places AS (SELECT source_file, sheet_name, unnest(range(last_col + 1)) AS col FROM spans),
    n0 AS (SELECT p.*, coalesce(nullif(trim(h.value), ''), 'Unnamed: ' || cast(p.col AS varchar))
             AS name
           FROM places p LEFT JOIN g h ON h.source_file = p.source_file
             AND h.sheet_name = p.sheet_name AND h.col = p.col AND h."row" = {header_row}),
    n1 AS (SELECT source_file, sheet_name, col, name AS plain, CASE WHEN k = 0 THEN name
             ELSE name || '.' || cast(k AS varchar) END AS name
           FROM (SELECT *, row_number() OVER (PARTITION BY source_file, sheet_name, name
                                              ORDER BY col) - 1 AS k FROM n0)),
    s1 AS (SELECT source_file, sheet_name, list(name ORDER BY col) AS names,
             list(plain ORDER BY col) AS plain FROM n1 GROUP BY ALL),
    n2 AS (SELECT source_file, sheet_name, CASE WHEN len(list_distinct(names)) = len(names)
             THEN names ELSE list_reduce(list_transform(plain, lambda p: [p]), lambda used, p:
               list_append(used, CASE WHEN NOT list_contains(used, p[1]) THEN p[1]
                 ELSE list_filter(list_transform(range(1, len(used) + 2),
                        lambda k: p[1] || '.' || cast(k AS varchar)),
                      lambda c: NOT list_contains(used, c))[1] END)) END AS names
           FROM s1)
    SELECT g.source_file, g.sheet_name, cast(g."row" AS bigint) AS "row",
      coalesce(n2.names[g.col + 1],
        CASE WHEN list_contains(n2.names, 'Unnamed: ' || cast(g.col AS varchar))
          THEN 'Unnamed: ' || cast(g.col AS varchar) || '.1'
          ELSE 'Unnamed: ' || cast(g.col AS varchar) END) AS name, g.value
    FROM g LEFT JOIN n2 ON n2.source_file = g.source_file AND n2.sheet_name = g.sheet_name
    WHERE g."row" > {header_row}"""


_DIMS = """SELECT source_file, sheet_name, cast(max("row") + 1 AS bigint) AS max_row,
  cast(max(col) + 1 AS integer) AS max_column,
  cast(max("row") + 1 AS varchar) || 'x' || cast(max(col) + 1 AS varchar) AS dimensions
FROM g GROUP BY ALL"""

QUERIES = {
    "text_cells_count": text_cells_count,
    "sheet_dims": sheet_dims_documents,
    "sheet_dims_turns": sheet_dims_turns,
    "grid_preview": grid_preview,
    "range_slice": range_slice,
    "range_slice_open": range_slice_open,
    "table_to_cells": table_to_cells,
    "cells_pivot_roundtrip": cells_pivot_roundtrip,
    "rows_as_maps": rows_as_maps_documents,
    "promote_header": promote_header_documents,
    "promote_header_columns": promote_header_columns,
    "promote_header_compat": promote_header_compat,
    "renumber_rows": renumber_rows_bom,
    "clean_rows_cols": clean_rows_cols,
    "xlsx_roundtrip": xlsx_roundtrip,
    "xlsx_sheets": xlsx_sheets,
}

ORACLES = {
    "text_cells_count": _documents
    + """SELECT sheet_name, count(*) AS n_cells, cast(sum(length(value)) AS bigint) AS n_chars,
      cast(sum("row" + col) AS bigint) AS position_sum FROM g GROUP BY ALL""",
    "sheet_dims": _documents + _DIMS,
    "sheet_dims_turns": "WITH "
    + DOCUMENT_CELLS.replace("doc_id", "conv_id")
    .replace("lang AS", "cast(turn AS varchar) AS")
    .replace("FROM documents", "FROM conversations")
    + _DIMS,
    "grid_preview": _documents
    + """, d AS (SELECT source_file, sheet_name, max("row") + 1 AS nr, max(col) + 1 AS nc
            FROM g GROUP BY ALL),
    p AS (SELECT source_file, sheet_name, r, unnest(range(least(10, nc))) AS c
          FROM (SELECT *, unnest(range(least(5, nr))) AS r FROM d))
    SELECT p.source_file, p.sheet_name, cast(r AS bigint) AS "row",
      string_agg(coalesce(substring(value, 1, 20), ''), '|' ORDER BY c) AS preview
    FROM p LEFT JOIN g ON g.source_file = p.source_file AND g.sheet_name = p.sheet_name
      AND g."row" = r AND g.col = c
    GROUP BY p.source_file, p.sheet_name, r""",
    "range_slice": _documents
    + """SELECT source_file, sheet_name, cast("row" AS bigint) AS "row",
      cast(col AS integer) AS col, value FROM g
    WHERE "row" BETWEEN 2 AND 5 AND col BETWEEN 1 AND 3""",
    "range_slice_open": _documents
    + """SELECT source_file, sheet_name, cast("row" AS bigint) AS "row",
      cast(col AS integer) AS col, value FROM g WHERE "row" >= 3 AND col >= 4""",
    "table_to_cells": """
    SELECT p_brand AS source_file, p_type AS sheet_name, p_partkey AS "row", col, cell_type, value
    FROM (SELECT *, 0 AS col, 'number' AS cell_type, cast(p_partkey AS varchar) AS value FROM part
      UNION ALL SELECT *, 1, 'string', p_name FROM part
      UNION ALL SELECT *, 2, 'string', p_brand FROM part
      UNION ALL SELECT *, 3, 'string', p_type FROM part
      UNION ALL SELECT *, 4, 'number', cast(p_size AS varchar) FROM part)""",
    "cells_pivot_roundtrip": "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part",
    "rows_as_maps": _documents
    + """SELECT source_file, sheet_name, cast("row" AS bigint) AS "row",
      cast(count(*) AS integer) AS n_keys, max(CASE WHEN col = 1 THEN value END) AS col_1
    FROM g WHERE trim(value) <> '' GROUP BY ALL""",
    "promote_header": _documents + _header_sql(0),
    "promote_header_columns": _bom
    + """SELECT source_file, sheet_name, cast("row" AS bigint) AS "row",
      max(CASE WHEN col = 1 THEN value END) AS part_number,
      max(CASE WHEN col = 2 THEN value END) AS description,
      max(CASE WHEN col = 3 THEN value END) AS quantity
    FROM g WHERE "row" > 2 AND "row" <> 4 GROUP BY ALL""",
    "promote_header_compat": _documents + _header_sql(1),
    "renumber_rows": _bom
    + """SELECT source_file, sheet_name,
      dense_rank() OVER (PARTITION BY source_file, sheet_name ORDER BY "row") - 1 AS "row",
      cast(col AS integer) AS col, value FROM g""",
    "clean_rows_cols": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'",
    "xlsx_roundtrip": _CUSTOMER_CELLS,
    "xlsx_sheets": f"""
    SELECT source_file, cast(row_number() OVER (PARTITION BY source_file ORDER BY sheet_name) - 1
        AS integer) AS sheet_index,
      sheet_name, max("row") + 1 AS n_rows, 3 AS n_cols
    FROM ({_CUSTOMER_CELLS}) GROUP BY source_file, sheet_name""",
}
