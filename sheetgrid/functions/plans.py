"""Keeping an expensive expression from being computed more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(value: Column) -> Column:
    """The value as a generated column, for use in a select list of its own.

    The optimizer copies a plain expression into every filter on it that can be
    moved below the projection, and so computes it once per filter; it does not
    do so for the output of a generator.
    """
    return F.explode(F.array(value))


def pin_cells(grid: DataFrame) -> DataFrame:
    """The grid with `cells` computed once, before they are tested and exploded.

    Matters where `cells` is an expression, as in a view of text. Operators that
    do not look at cells should not call this, so that the expression is pruned.
    """
    return grid.withColumn("cells", computed_once(F.col("cells")))
