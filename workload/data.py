"""Test tables, scratch folders and grids derived from the tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetgrid.sources.views import make_cell, make_row, text_to_grid
from workload.xlsx_bytes import cell_xml, sheet_xml, workbook_bytes

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sheetgrid-")  # one machine, and nothing said
    return f"{base.rstrip('/')}/sheetgrid/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: computed once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def document_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sheet: line = row, word = column."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return text_to_grid(documents, "text", "doc_id", "lang")


# The same grid in SQL, as cells.
DOCUMENT_CELLS = """
lines AS (
  SELECT cast(doc_id AS varchar) AS source_file, lang AS sheet_name,
         unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS "row"
  FROM documents),
g AS MATERIALIZED (
  SELECT * FROM (
    SELECT source_file, sheet_name, "row",
           generate_subscripts(string_split(line, ' '), 1) - 1 AS col,
           'string' AS cell_type, unnest(string_split(line, ' ')) AS value
    FROM lines)
  WHERE value <> '')
"""


@dataclass(frozen=True)
class Part:
    """Rows that one table puts into a form.

    `source` is a query, `rows` pairs a row number with (col, type, text) cells.
    Everything is SQL that Spark and the check engine read alike; a null text
    leaves the cell empty.
    """

    source: str
    rows: tuple[tuple[str, tuple[tuple[int, str, str], ...]], ...]


@dataclass(frozen=True)
class Form:
    """Workbooks that a template should own, filled in from the tables."""

    file: str
    sheet: str
    parts: tuple[Part, ...]


SDM_FORM = Form(
    "concat('SDM_', cast(user_id AS string), '.xlsx')",
    "event_type",
    (
        Part(
            "SELECT user_id, event_type, cast(min(cast(ts AS date)) AS string) AS first_day"
            " FROM {events} GROUP BY user_id, event_type",
            (
                ("1", ((2, "string", "'Industrial Acura S.A.'"),)),
                ("3", ((0, "string", "'Fecha'"), (2, "datetime", "first_day"))),
                ("11", ((1, "string", "'INDUSTRIAL ACURA, planta 2'"),)),
                (
                    "12",
                    (
                        (1, "string", "'  '"),
                        (2, "string", "first_day"),
                        (3, "string", "'fecha de corte'"),
                    ),
                ),
            ),
        ),
        Part(
            "SELECT event_id, user_id, event_type, props FROM {events}",
            (
                (
                    "20 + event_id",
                    (
                        (0, "number", "cast(event_id AS string)"),
                        (1, "string", "CASE WHEN user_id > 50 THEN event_type END"),
                        (3, "string", "props"),
                    ),
                ),
            ),
        ),
    ),
)

QUOTATION_FORM = Form(
    "concat('COTIZACION_', cast(c_custkey AS string), '.xlsx')",
    "c_mktsegment",
    (
        Part(
            "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM {customer}",
            (
                ("1", ((3, "string", "'Industrial Acura, S.A. de C.V.'"),)),
                (
                    "3",
                    (
                        (0, "string", "'Cliente:'"),
                        (1, "string", "c_name"),
                        (3, "string", "'fuera'"),
                    ),
                ),
                (
                    "4",
                    (
                        (0, "string", "'Formato de Cotización - Folio'"),
                        (1, "number", "cast(c_custkey AS string)"),
                    ),
                ),
                (
                    "5",
                    (
                        (1, "string", "'Folio'"),
                        (3, "number", "cast(c_nationkey AS string)"),
                    ),
                ),
                (
                    "6",
                    (
                        (0, "string", "'código de diseño'"),
                        (2, "string", "concat('N-', cast(c_nationkey AS string))"),
                    ),
                ),
                ("7", ((0, "string", "' '"), (2, "string", "'Codigo de Diseño'"))),
            ),
        ),
    ),
)

BOM_FORM = Form(
    "concat('BOM_', p_brand, '.xlsx')",
    "p_type",
    (
        Part(
            "SELECT DISTINCT p_brand, p_type FROM {part}",
            (
                (
                    "2",
                    (
                        (0, "string", "'No. de Partida'"),
                        (1, "string", "'Part Number / NP'"),
                        (2, "string", "'Descripción'"),
                        (3, "string", "'Cantidad'"),
                    ),
                ),
                ("4", ((3, "string", "'Qty / Quantity'"),)),
            ),
        ),
        Part(
            "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM {part}",
            (
                (
                    "5 + p_partkey",
                    (
                        (0, "number", "cast(p_partkey AS string)"),
                        (1, "string", "concat('P-', cast(p_partkey AS string))"),
                        (2, "string", "CASE WHEN p_size <= 40 THEN p_name END"),
                        (3, "number", "cast(p_size AS string)"),
                    ),
                ),
            ),
        ),
    ),
)

SALES_FORM = Form(
    "concat('VENTAS_', cast(o_orderkey AS string), '.xlsx')",
    "o_orderstatus",
    (
        Part(
            "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,"
            " cast(cast(o_orderdate AS date) AS string) AS day FROM {orders}",
            (
                (
                    "0",
                    (
                        (0, "string", "'Nombre del Cliente'"),
                        (1, "string", "concat('C-', cast(o_custkey AS string))"),
                    ),
                ),
                (
                    "1",
                    (
                        (0, "string", "'NOMBRE DEL PROYECTO:'"),
                        (2, "string", "o_orderpriority"),
                    ),
                ),
                ("2", ((2, "string", "'Fecha requerida'"), (3, "datetime", "day"))),
                ("3", ((1, "string", "'Fecha'"), (2, "datetime", "day"))),
                (
                    "4",
                    (
                        (0, "string", "'Fecha de Cotización'"),
                        (2, "datetime", "day"),
                        (3, "string", "'lejos'"),
                    ),
                ),
                ("5", ((3, "string", "o_orderstatus"), (4, "string", "'nombre del vendedor'"))),
            ),
        ),
    ),
)

FORMS = {"sdm": SDM_FORM, "quotation": QUOTATION_FORM, "bom": BOM_FORM, "sales": SALES_FORM}


def form_grid(spark: SparkSession, sf_dir: str, form: Form) -> DataFrame:
    """The grid of a form over the whole of its tables."""
    grid = None
    for part in form.parts:
        names = [n for n in TABLES if "{" + n + "}" in part.source]
        source = spark.sql(part.source, **{n: table(spark, sf_dir, n) for n in names})
        rows = F.array(
            *[
                F.struct(
                    F.expr(number).cast("long").alias("row"),
                    make_row([make_cell(c, F.expr(text), kind) for c, kind, text in cells]).alias(
                        "cells"
                    ),
                )
                for number, cells in part.rows
            ]
        )
        piece = source.select(
            F.expr(form.file).alias("source_file"),
            F.expr(form.sheet).alias("sheet_name"),
            F.inline(rows),
        )
        grid = piece if grid is None else grid.unionByName(piece)
    return grid


def form_cells_sql(form: Form) -> str:
    """CTE `g` with the cells of a form."""
    selects = []
    for part in form.parts:
        source = part.source.format(**{n: n for n in TABLES})
        for number, cells in part.rows:
            for col, kind, text in cells:
                selects.append(
                    f"SELECT {form.file} AS source_file, {form.sheet} AS sheet_name,"
                    f' {number} AS "row", {col} AS col, \'{kind}\' AS cell_type,'
                    f" {text} AS value FROM ({source})"
                )
    union = "\nUNION ALL ".join(selects)
    return f"g AS MATERIALIZED (SELECT * FROM ({union}) WHERE value IS NOT NULL AND value <> '')"


def pack_workbooks(grid: DataFrame) -> DataFrame:
    """(path, content) workbooks of a grid whose files are small by construction."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        sheets = []
        for name, sheet in rows.sort_values("row").groupby("sheet_name", sort=True):
            lines = []
            for row, cells in zip(sheet["row"], sheet["cells"]):
                xml = "".join(
                    cell_xml(
                        row, c["col"], int(c["value"]) if c["cell_type"] == "number" else c["value"]
                    )
                    for c in cells
                )
                lines.append((row, xml))
            sheets.append((name, sheet_xml(lines)))
        return pd.DataFrame(
            {"path": [rows["source_file"].iloc[0]], "content": [workbook_bytes(sheets)]}
        )

    return grid.groupBy("source_file").applyInPandas(pack, "path string, content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Write (path, content) records as files; tasks may be repeated safely.

    `folder` is a path as Spark takes it, with any scheme or none, that all executors share. It
    is made here, so a task that does not see it fails instead of writing to its own disk.
    """
    context = files.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(path)
    place = store.resolvePath(path).toUri().toString()  # behind Spark's own names, such as a mount point's

    def write(rows) -> None:
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(place)
        for row in rows:
            with filesystem.open_output_stream(f"{base}/{row['path']}") as stream:
                stream.write(bytes(row["content"]))

    files.foreachPartition(write)
