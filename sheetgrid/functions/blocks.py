"""Joining rows with facts about their sheet, without hot keys.

A join on (source_file, sheet_name) sends all rows of a sheet to one task. The
helpers here first cut sheets into blocks of consecutive rows and repeat each
sheet's fact once per block that holds rows, so the join key is (source_file,
sheet_name, block) and the largest unit of work is one block, whatever the
sheet's size. Only blocks in use count: row numbers may have gaps of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetgrid.model import BLOCK_ROWS, SHEET_KEYS

BLOCK = "_block"


def block_of(row: Column, block_rows: int = BLOCK_ROWS) -> Column:
    return F.call_function("div", row, F.lit(block_rows)).cast("long")


def sheet_blocks(grid: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The blocks of each sheet that hold rows.

    Reads no cell; rows of a block merge within the task that reads them.
    """
    return grid.select(
        *SHEET_KEYS, block_of(F.col("row"), block_rows).alias(BLOCK)
    ).distinct()


def blocks_of_sheets(sheets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The blocks of workbook sheets of known length, without looking at rows.

    A workbook sheet has at most 1,048,576 rows, hence few blocks.
    """
    last = block_of(F.col("n_rows") - 1, block_rows)
    return sheets.where(F.col("n_rows") > 0).select(
        *SHEET_KEYS, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias(BLOCK)
    )


def spread_facts(
    facts: DataFrame,
    blocks: DataFrame,
    first_row: Column | None = None,
    on: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Repeat a sheet's facts (a few records) for its blocks from first_row on."""
    spread = facts.join(blocks, [*SHEET_KEYS, *on])
    if first_row is not None:
        spread = spread.where(F.col(BLOCK) >= block_of(first_row, block_rows))
    return spread


def join_by_block(
    rows: DataFrame,
    spread: DataFrame,
    on: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inner-join `rows` (with a 0-based `row`) to the spread facts of their sheet."""
    return (
        rows.withColumn(BLOCK, block_of(F.col("row"), block_rows))
        .join(spread, [*SHEET_KEYS, *on, BLOCK])
        .drop(BLOCK)
    )
