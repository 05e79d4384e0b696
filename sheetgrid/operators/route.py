"""Which template owns a workbook."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetgrid.functions.text import has_keyword
from sheetgrid.plans.rules import BUILT_IN, WORKBOOK_EXTENSIONS, Template


def _owns(template: Template, path: Column, sheet: Column) -> Column:
    """The same test as `Template.owns`, for one sheet of the file."""
    test = F.lit(False)
    if template.path_keywords:
        test = test | has_keyword(path, template.path_keywords)
    if template.sheet_keywords:
        test = test | F.coalesce(has_keyword(sheet, template.sheet_keywords), F.lit(False))
    if template.any_file:
        for extension in WORKBOOK_EXTENSIONS:
            test = test | F.upper(path).endswith(extension)
    return test


def route_templates(
    sheets: DataFrame,
    templates: Sequence[Template] = BUILT_IN,
    match: str = "name",
) -> DataFrame:
    """(source_file, template): the first template, in order, that owns the file.

    A template owns a file whose path, or any of whose sheet names, holds one
    of its keywords. match="name" tests the file name only; match="path" the
    whole path with its folders. Files no template owns get null.
    """
    if match not in ("name", "path"):
        raise ValueError(f"match must be 'name' or 'path', not {match!r}")
    file = F.col("source_file")
    path = file if match == "path" else F.substring_index(file, "/", -1)
    priority = F.coalesce(
        *[
            F.when(_owns(t, path, F.col("sheet_name")), F.lit(i))
            for i, t in enumerate(templates)
        ]
    )
    names = F.array(*[F.lit(t.name) for t in templates])
    return (
        sheets.groupBy("source_file")
        .agg(F.min(priority).alias("_priority"))
        .select("source_file", F.get(names, F.col("_priority")).alias("template"))
    )
