"""Label-anchored extraction: the cell itself, beside, below, or all rows after.

SELF and NEAR look along a row and are narrow. BELOW and AFTER look down a
sheet and join on blocks of rows, so no sheet or column is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetgrid.functions.blocks import (
    BLOCK,
    block_of,
    blocks_of_sheets,
    join_by_block,
    sheet_blocks,
    spread_facts,
)
from sheetgrid.functions.plans import computed_once, pin_cells
from sheetgrid.functions.text import contains_any, is_not_blank
from sheetgrid.model import BLOCK_ROWS, BOOLEAN, NUMBER, SHEET_KEYS, STRING
from sheetgrid.operators.grid import row_as_map
from sheetgrid.plans.rules import (
    AFTER,
    BELOW,
    NEAR,
    SELF,
    Rule,
    Template,
    rules_of_shape,
)

# Columns on either side of a label that may hold its value.
REACH = 2

TAGS = ["template", "data_type"]
RECORD = [*SHEET_KEYS, *TAGS, "label", "value", "row", "column"]
ROW_MAP = [*SHEET_KEYS, *TAGS, "row", "cells"]

Rules = Sequence[tuple[Template, Rule]]


class Extracts(NamedTuple):
    records: DataFrame  # RECORD columns, from SELF, NEAR and BELOW rules
    row_maps: DataFrame  # ROW_MAP columns, from AFTER rules


def _keyword_test(upper: Column, rule: Rule) -> Column:
    test = contains_any(upper, [k.upper() for k in rule.keywords])
    if rule.exclude:
        test = test & ~contains_any(upper, [k.upper() for k in rule.exclude])
    return test


def _applies(grid: DataFrame, template: Template, rule: Rule) -> Column:
    """The rule may look at this row: its sheet's owner and the row limit."""
    test = F.lit(True) if rule.max_row is None else F.col("row") < rule.max_row
    return test & (F.col("_owner") == template.name) if _is_owned(grid) else test


def _is_owned(grid: DataFrame) -> bool:
    """Rows carry the template that owns their file."""
    return "template" in grid.columns


def _of_templates(grid: DataFrame, rules: Rules) -> DataFrame:
    """Rows of the templates with such rules; prunes a grid stored by template."""
    if not _is_owned(grid):
        return grid
    return grid.where(F.col("template").isin(sorted({t.name for t, _ in rules})))


def _visible(grid: DataFrame, rules: Rules) -> DataFrame:
    """Keep only the rows some rule may look at; reaches a Parquet scan."""
    grid = _of_templates(grid, rules)
    bounds = [rule.max_row for _, rule in rules]
    if None not in bounds:
        grid = grid.where(F.col("row") < max(bounds))
    return grid.withColumnRenamed("template", "_owner")


def _row_may_match(rules: Rules) -> Column:
    """Some keyword occurs in the text of the row, all cells taken together.

    One upper-casing and one search per row and keyword dismiss rows without a
    label before their cells are looked at. The array of one element binds the
    upper-cased text, so that it is computed once for all keywords.
    """
    words = sorted({k.upper() for _, rule in rules for k in rule.keywords})
    text = F.upper(F.array_join(F.col("cells.value"), "\n"))
    return F.exists(F.array(text), lambda t: contains_any(t, words))


def _tagged(hits: DataFrame, tests: list[Column], rules: Rules) -> DataFrame:
    """One record per hit and rule it passes, with the rule's constants."""
    constants = F.array(
        *[
            F.struct(
                F.lit(template.name).alias("template"),
                F.lit(rule.data_type).alias("data_type"),
                F.lit(rule.shape).alias("_shape"),
                F.lit(rule.label).cast("string").alias("_label"),
            )
            for template, rule in rules
        ]
    )
    passes = F.lit(False)
    for i, test in enumerate(tests):
        passes = F.when(F.col("_rule") == i, test).otherwise(passes)
    return (
        hits.withColumn("_rule", F.explode(F.array(*[F.lit(i) for i in range(len(rules))])))
        .where(passes)
        .withColumn("_tag", F.get(constants, F.col("_rule")))
        .select("*", "_tag.*")
        .drop("_rule", "_tag")
    )


def match_labels(grid: DataFrame, rules: Rules) -> DataFrame:
    """One record per label cell and rule it answers to, for all rules in one pass.

    Adds `_reach`: the cells of the label's row that can lie within REACH
    columns. Cells are ordered and their columns distinct, so those are within
    REACH array positions, and rows of any width cost the same per label.
    """
    cell = F.col("_cell")
    tests = [_applies(grid, *r) & _keyword_test(F.col("_upper"), r[1]) for r in rules]
    owner = ["_owner"] if _is_owned(grid) else []
    first = F.greatest(F.col("_pos") + 1 - REACH, F.lit(1))
    last = F.col("_pos") + 1 + REACH
    hits = (
        pin_cells(_visible(grid, rules))
        .where(_row_may_match(rules))
        .select(*SHEET_KEYS, *owner, "row", "cells", F.posexplode("cells").alias("_pos", "_cell"))
        .where(cell["cell_type"] == STRING)
        .withColumn("_upper", computed_once(F.upper(cell["value"])))
        .where(reduce(lambda a, b: a | b, tests))
        .select(
            *SHEET_KEYS,
            *owner,
            "row",
            "_upper",
            cell["col"].alias("col"),
            cell.alias("_cell"),
            F.slice("cells", first, last - first + 1).alias("_reach"),
        )
    )
    return (
        _tagged(hits, tests, rules)
        .withColumn("label", F.coalesce(F.col("_label"), cell["value"]))
        .drop("_label", "_upper", *owner)
    )


def _record(value: Column, row: Column, col: Column) -> list[Column]:
    """Output columns; positions become 1-based."""
    return [
        *[F.col(c) for c in [*SHEET_KEYS, *TAGS, "label"]],
        value.alias("value"),
        (row + 1).cast("long").alias("row"),
        (col + 1).cast("int").alias("column"),
    ]


def _self_and_near(hits: DataFrame) -> DataFrame:
    found = F.col("_found")
    candidates = F.when(F.col("_shape") == SELF, F.array("_cell")).otherwise(
        F.col("_reach")
    )
    return (
        hits.withColumn("_found", F.explode(candidates))
        .where((F.abs(found["col"] - F.col("col")) <= REACH) & is_not_blank(found["value"]))
        .select(_record(found["value"], F.col("row"), found["col"]))
    )


def _near_with_nan(
    hits: DataFrame, widths: DataFrame, blocks: DataFrame, block_rows: int
) -> DataFrame:
    """NEAR that writes empty neighbours as 'nan' and drops zeros and blanks."""
    at = F.col("_at")
    cell = F.get(F.filter("_reach", lambda c: c["col"] == at), F.lit(0))
    kept = (
        F.when(cell["cell_type"] == NUMBER, cell["value"].try_cast("double") != 0)
        .when(cell["cell_type"] == BOOLEAN, F.lower(cell["value"]) == "true")
        .otherwise(is_not_blank(cell["value"]))
    )
    positions = F.sequence(
        F.greatest(F.col("col") - REACH, F.lit(0)),
        F.least(F.col("col") + REACH, F.col("n_cols") - 1),
    )
    return (
        join_by_block(hits, spread_facts(widths, blocks), block_rows=block_rows)
        .withColumn("_at", F.explode(positions))
        .where(cell.isNull() | kept)
        .select(_record(F.coalesce(cell["value"], F.lit("nan")), F.col("row"), at))
    )


def _below(
    grid: DataFrame, hits: DataFrame, blocks: DataFrame, on: tuple[str, ...], block_rows: int
) -> DataFrame:
    """Every non-blank cell under a label, once per label above it.

    Whole rows meet the columns that have labels above in their sheet and block, so rows of sheets
    without a label go no further and only cells of such columns are unpacked. A cell then
    meets the labels of its column, cut by the block they stand in: a key is one block of
    cells and one block of labels at most, however many a column has.
    """
    keys = [*SHEET_KEYS, BLOCK]
    hits = hits.withColumn("_from", block_of(F.col("row"), block_rows))
    # From each block with labels to the blocks of its sheet from there on: a few records.
    reach = (
        hits.select(*SHEET_KEYS, *on, "_from")
        .distinct()
        .join(blocks, [*SHEET_KEYS, *on])
        .where(F.col(BLOCK) >= F.col("_from"))
    )
    labels = hits.join(reach, [*SHEET_KEYS, *on, "_from"]).select(
        *keys, "col", "_from", F.col("row").alias("_label_row"), *TAGS, "label"
    )
    spots = (
        labels.select(*keys, "col", "_from")
        .distinct()
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("col", "_from")).alias("_spots"))
    )
    under = F.flatten(
        F.transform(
            F.filter("cells", lambda c: is_not_blank(c["value"])),
            lambda c: F.transform(
                F.filter("_spots", lambda s: s["col"] == c["col"]),
                lambda s: F.struct(s["col"], s["_from"], c["value"]),
            ),
        )
    )
    values = (
        grid.select(*SHEET_KEYS, block_of(F.col("row"), block_rows).alias(BLOCK), "row", "cells")
        .join(spots, keys)
        .select(*keys, "row", F.inline(under).alias("col", "_from", "value"))
    )
    return (
        values.join(labels, [*keys, "col", "_from"])
        .where(F.col("row") > F.col("_label_row"))
        .select(_record(F.col("value"), F.col("row"), F.col("col")))
    )


def find_anchors(grid: DataFrame, rules: Rules) -> DataFrame:
    """First row per sheet and rule with a cell (of any type) holding a keyword."""

    def anywhere(rule: Rule) -> Column:
        return F.exists("_uppers", lambda u: _keyword_test(u, rule))

    tests = [_applies(grid, *r) & anywhere(r[1]) for r in rules]
    owner = ["_owner"] if _is_owned(grid) else []
    rows = (
        pin_cells(_visible(grid, rules))
        .where(_row_may_match(rules))
        .select(
            *SHEET_KEYS,
            *owner,
            "row",
            computed_once(F.transform(F.col("cells.value"), F.upper)).alias("_uppers"),
        )
    )
    return (
        _tagged(rows, tests, rules)
        .groupBy(*SHEET_KEYS, *TAGS)
        .agg(F.min("row").alias("anchor_row"))
    )


def _after(
    grid: DataFrame, anchors: DataFrame, blocks: DataFrame, on: tuple[str, ...], block_rows: int
) -> DataFrame:
    reach = spread_facts(anchors, blocks, F.col("anchor_row") + 1, on, block_rows)
    rows = grid.select(
        *SHEET_KEYS, block_of(F.col("row"), block_rows).alias(BLOCK), "row", "cells"
    )
    # Maps are made of the rows that are found, not of those looked at.
    return (
        rows.join(reach, [*SHEET_KEYS, BLOCK])
        .where(F.col("row") > F.col("anchor_row"))
        .select(
            *SHEET_KEYS,
            *TAGS,
            (F.col("row") + 1).alias("row"),
            computed_once(row_as_map("cells")).alias("cells"),
        )
        .where(F.size("cells") > 0)
    )


def sheet_widths(grid: DataFrame) -> DataFrame:
    """Column count of every sheet."""
    return grid.groupBy(*SHEET_KEYS).agg(
        (F.max(F.element_at("cells", -1)["col"]) + 1).alias("n_cols")
    )


def _one(rule: Rule | None, shape: str, keywords: Sequence[str], **kw) -> Rules:
    rule = rule or Rule(shape, shape, tuple(keywords), **kw)
    return [(Template("adhoc"), rule)]


def self_cells(grid: DataFrame, keywords: Sequence[str], max_row: int | None = None) -> DataFrame:
    """Text cells that hold a keyword."""
    return _self_and_near(match_labels(grid, _one(None, SELF, keywords, max_row=max_row)))


def near(
    grid: DataFrame,
    keywords: Sequence[str],
    blank: str = "skip",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Cells within two columns of a label, the label included.

    blank="skip" drops absent and blank neighbours and keeps zeros;
    blank="nan" writes absent neighbours as 'nan' and drops blanks, zeros and
    False.
    """
    hits = match_labels(grid, _one(None, NEAR, keywords))
    if _check_blank(blank) == "skip":
        return _self_and_near(hits)
    return _near_with_nan(hits, sheet_widths(grid), sheet_blocks(grid, block_rows), block_rows)


def below(grid: DataFrame, keywords: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Non-blank cells under each label, in its column."""
    hits = match_labels(grid, _one(None, BELOW, keywords))
    return _below(grid, hits, sheet_blocks(grid, block_rows), (), block_rows)


def after(
    grid: DataFrame,
    keywords: Sequence[str],
    max_row: int = 20,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows after the sheet's first anchor row, as `col_<i>` -> text maps."""
    anchors = find_anchors(grid, _one(None, AFTER, keywords, max_row=max_row))
    return _after(grid, anchors, sheet_blocks(grid, block_rows), (), block_rows)


def _check_blank(blank: str) -> str:
    if blank not in ("skip", "nan"):
        raise ValueError(f"blank must be 'skip' or 'nan', not {blank!r}")
    return blank


def extract(
    grid: DataFrame,
    templates: Sequence[Template],
    routes: DataFrame | None = None,
    blank: str = "skip",
    sheets: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> Extracts:
    """Run the rules of all templates over all sheets.

    A rule applies only to the files its template owns if the grid has a
    `template` column (as ingested workbooks do) or `routes` (source_file,
    template) is given; else every rule applies to every file. `sheets` saves
    finding the size of the sheets from their rows.
    """
    _check_blank(blank)
    on: tuple[str, ...] = ()
    if sheets is None:
        widths, blocks = sheet_widths(grid), sheet_blocks(grid, block_rows)
    else:
        widths = sheets.select(*SHEET_KEYS, "n_cols")
        blocks = blocks_of_sheets(sheets, block_rows)
    if routes is not None:
        owners = routes.select("source_file", "template")
        blocks = blocks.join(owners, "source_file")
        on = ("template",)

    def owned(hits: DataFrame) -> DataFrame:
        return hits if routes is None else join_by_block(hits, blocks, on, block_rows)

    parts = []
    in_row = rules_of_shape(templates, SELF, NEAR)
    if in_row:
        hits = owned(match_labels(grid, in_row))
        if blank == "skip":
            parts.append(_self_and_near(hits))
        else:
            parts.append(_self_and_near(hits.where(F.col("_shape") == SELF)))
            parts.append(
                _near_with_nan(
                    hits.where(F.col("_shape") == NEAR),
                    widths,
                    blocks.select(*SHEET_KEYS, BLOCK),
                    block_rows,
                )
            )
    down = rules_of_shape(templates, BELOW)
    if down:
        below_grid = _of_templates(grid, down)
        parts.append(_below(below_grid, match_labels(grid, down), blocks, on, block_rows))
    spark = grid.sparkSession
    if parts:
        records = reduce(DataFrame.unionByName, parts)
    else:
        records = spark.createDataFrame(
            [],
            "source_file string, sheet_name string, template string, data_type string,"
            " label string, value string, row long, column int",
        )

    anchored = rules_of_shape(templates, AFTER)
    if anchored:
        after_grid = _of_templates(grid, anchored)
        row_maps = _after(after_grid, find_anchors(grid, anchored), blocks, on, block_rows)
    else:
        row_maps = spark.createDataFrame(
            [],
            "source_file string, sheet_name string, template string, data_type string,"
            " row long, cells map<string,string>",
        )
    return Extracts(records.select(*RECORD), row_maps.select(*ROW_MAP))


def as_table(records: DataFrame, rule: Rule, template: Template) -> DataFrame:
    """One extractor's records under its own field names."""
    label, value = rule.fields
    return records.where(
        (F.col("template") == template.name) & (F.col("data_type") == rule.data_type)
    ).select(
        *SHEET_KEYS,
        F.col("label").alias(label),
        F.col("value").alias(value),
        "row",
        "column",
    )
