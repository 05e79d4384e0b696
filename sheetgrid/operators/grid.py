"""Operators on grid rows: ranges, headers, anchors, cleaning, previews."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetgrid.functions.blocks import BLOCK, block_of, join_by_block, sheet_blocks
from sheetgrid.functions.plans import computed_once, pin_cells
from sheetgrid.functions.text import (
    contains_any,
    has_keyword,
    is_not_blank,
    strip,
)
from sheetgrid.model import BLOCK_ROWS, SHEET_KEYS, STRING
from sheetgrid.plans.rules import CENSUS_KEYWORDS


def row_as_map(cells: str) -> Column:
    """Non-blank cells as a `col_<i>` -> text map."""
    filled = F.filter(cells, lambda c: is_not_blank(c["value"]))
    return F.map_from_entries(
        F.transform(
            filled, lambda c: F.struct(F.concat(F.lit("col_"), c["col"]), c["value"])
        )
    )


def rows_as_maps(grid: DataFrame) -> DataFrame:
    """Every row as a sparse record. Rows with only blank text are left out."""
    return grid.select(
        *SHEET_KEYS, "row", computed_once(row_as_map("cells")).alias("cells")
    ).where(F.size("cells") > 0)


def slice_range(
    grid: DataFrame,
    start_row: int,
    end_row: int | None = None,
    start_col: int = 0,
    end_col: int | None = None,
) -> DataFrame:
    """Rows and columns of an inclusive range; None leaves an end open."""
    rows = grid.where(F.col("row") >= start_row)
    if end_row is not None:
        rows = rows.where(F.col("row") <= end_row)
    if start_col > 0 or end_col is not None:

        def inside(c: Column) -> Column:
            test = c["col"] >= start_col
            return test if end_col is None else test & (c["col"] <= end_col)

        inner = computed_once(F.filter("cells", inside))
        rows = rows.withColumn("cells", inner).where(F.size("cells") > 0)
    return rows


def sheet_dims(grid: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """max_row, max_column and "RxC" of every sheet.

    Taken from `sheets` when given (which also lists empty sheets), else from
    the extent of the data.
    """
    if sheets is None:
        dims = grid.groupBy(*SHEET_KEYS).agg(
            (F.max("row") + 1).alias("max_row"),
            (F.max(F.element_at("cells", -1)["col"]) + 1).alias("max_column"),
        )
    else:
        dims = sheets.select(
            *SHEET_KEYS,
            F.col("n_rows").alias("max_row"),
            F.col("n_cols").alias("max_column"),
        )
    return dims.withColumn("dimensions", F.concat_ws("x", "max_row", "max_column"))


def find_anchor(grid: DataFrame, keywords: Sequence[str], max_rows: int = 20) -> DataFrame:
    """First row per sheet, within max_rows, with a cell holding a keyword."""
    return (
        grid.where(F.col("row") < max_rows)
        .where(F.exists("cells", lambda c: has_keyword(c["value"], keywords)))
        .groupBy(*SHEET_KEYS)
        .agg(F.min("row").alias("anchor_row"))
    )


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeats become `<name>.<k>`, with the smallest k from 1 that no name before has."""
    used: set[str] = set()
    tried: dict[str, int] = {}
    out = []
    for name in names:
        if name in used:
            k = tried.get(name, 1)
            while f"{name}.{k}" in used:
                k += 1
            tried[name] = k + 1
            name = f"{name}.{k}"
        used.add(name)
        out.append(name)
    return out


def _number_repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for headers in batches:
        headers["_names"] = headers["_names"].map(unique_names)
        yield headers


def _header_names(header: DataFrame) -> DataFrame:
    """Names by column: stripped, blanks as `Unnamed: <i>`, repeats numbered until unique.

    `header` is one row per sheet, and the names are made within it. The result holds a
    dense array, so that `names[col]` is a constant-time look-up.
    """
    unnamed = lambda i: F.concat(F.lit("Unnamed: "), i.cast("string"))

    def up_to(c: Column, i: Column) -> Column:
        # The gap before a cell, then the cell.
        before = F.coalesce(F.get("cells", i - 1)["col"], F.lit(-1))
        gap = F.transform(
            F.filter(F.sequence(before, c["col"]), lambda k: (k > before) & (k < c["col"])), unnamed
        )
        text = strip(c["value"])
        return F.concat(gap, F.array(F.when(is_not_blank(text), text).otherwise(unnamed(c["col"]))))

    dense = F.flatten(F.transform("cells", up_to))
    names = header.select(*SHEET_KEYS, dense.alias("_names"))
    return names.mapInPandas(_number_repeats, names.schema)


def _header_position(header_row: int, skip_rows: Sequence[int], header_compat: bool) -> int:
    if not header_compat:
        return header_row
    # The header is counted after `header_row` itself and the skipped rows are gone.
    skipped = {header_row, *skip_rows}
    position, left = 0, header_row
    while position in skipped or left > 0:
        left -= position not in skipped
        position += 1
    return position


def promote_header(
    grid: DataFrame,
    header_row: int = 0,
    skip_rows: Sequence[int] = (),
    columns: Sequence[str] | None = None,
    header_compat: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Read sheets as tables whose names stand in `header_row` (0-based).

    Returns the provenance, `row` and either a `fields` map or, with `columns`,
    one text column per name. `header_compat` takes the first row after
    `header_row` as header, as the skip-then-count reading does.
    """
    at = _header_position(header_row, skip_rows, header_compat)
    headers = _header_names(grid.where(F.col("row") == at))
    data = grid.where(F.col("row") > at)
    spread = sheet_blocks(data, block_rows).join(headers, SHEET_KEYS, "left")
    if skip_rows:
        data = data.where(~F.col("row").isin(*skip_rows))

    names = F.coalesce("_names", F.array().cast("array<string>"))

    def beyond(c: Column) -> Column:
        # A column past the header; its name may stand in the header by chance.
        name = F.concat(F.lit("Unnamed: "), c["col"].cast("string"))
        numbered = F.transform(
            F.sequence(F.lit(1), F.size(names) + 1), lambda k: F.concat_ws(".", name, k)
        )
        free = F.filter(numbered, lambda n: ~F.array_contains(names, n))
        return F.when(F.array_contains(names, name), F.get(free, F.lit(0))).otherwise(name)

    def entry(c: Column) -> Column:
        return F.struct(F.coalesce(F.get(names, c["col"]), beyond(c)), c["value"])

    table = join_by_block(data, spread, block_rows=block_rows).select(
        *SHEET_KEYS,
        "row",
        computed_once(F.map_from_entries(F.transform("cells", entry))).alias("fields"),
    )
    if columns is None:
        return table
    return table.select(*SHEET_KEYS, "row", *[F.col("fields")[c].alias(c) for c in columns])


def renumber_rows(grid: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the rows of each sheet 0, 1, 2, ... without gaps; other columns stay.

    Rows are counted per block first; a block's rows are then numbered on from
    the total of the blocks before it, so no window spans a whole sheet's rows.
    """
    counts = grid.groupBy(
        *SHEET_KEYS, block_of(F.col("row"), block_rows).alias(BLOCK)
    ).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*SHEET_KEYS)
        .orderBy(BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    others = [c for c in grid.columns if c not in (*SHEET_KEYS, "row")]
    offsets = counts.select(
        *SHEET_KEYS, BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    in_block = Window.partitionBy(*SHEET_KEYS, BLOCK).orderBy("row")
    return (
        grid.withColumn(BLOCK, block_of(F.col("row"), block_rows))
        .join(offsets, [*SHEET_KEYS, BLOCK])
        .withColumn("_rank", F.row_number().over(in_block))
        .select(
            *SHEET_KEYS,
            (F.col("_offset") + F.col("_rank") - 1).cast("long").alias("row"),
            *others,
        )
    )


def clean_grid(
    grid: DataFrame,
    remove_empty_rows: bool = True,
    remove_empty_cols: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Drop empty rows and columns and renumber the rows.

    Empty rows and columns are absent from a grid already, and columns keep
    their positions as labels, so only the numbering changes.
    """
    return renumber_rows(grid, block_rows) if remove_empty_rows else grid


def preview(grid: DataFrame, rows: int = 5, cols: int = 10, width: int = 20) -> DataFrame:
    """The top left corner of every sheet; empty cells as '', text cut to width."""
    dims = sheet_dims(grid)
    wanted = dims.select(
        *SHEET_KEYS,
        F.least(F.col("max_column"), F.lit(cols)).alias("_n"),
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.least(F.col("max_row"), F.lit(rows)) - 1)
        ).alias("row"),
    )
    corner = grid.where(F.col("row") < rows).select(
        *SHEET_KEYS, "row", F.filter("cells", lambda c: c["col"] < cols).alias("_cells")
    )

    def text_at(i: Column) -> Column:
        found = F.get(F.filter("_cells", lambda c: c["col"] == i), F.lit(0))
        return F.coalesce(F.substring(found["value"], 1, width), F.lit(""))

    return wanted.join(corner, [*SHEET_KEYS, "row"], "left").select(
        *SHEET_KEYS,
        "row",
        F.transform(F.sequence(F.lit(0), F.col("_n") - 1), text_at).alias("preview"),
    )


def keyword_census(
    grid: DataFrame, keywords: Sequence[str] = CENSUS_KEYWORDS, max_rows: int = 10
) -> DataFrame:
    """Distinct text cells of the top rows that hold one of the keywords."""
    return (
        pin_cells(grid.where(F.col("row") < max_rows))
        .select(*SHEET_KEYS, F.inline("cells"))
        .where(
            (F.col("cell_type") == STRING)
            & contains_any(F.lower("value"), [k.lower() for k in keywords])
        )
        .select(*SHEET_KEYS, "value")
        .distinct()
    )
