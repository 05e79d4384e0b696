"""Operators on ordinary DataFrames: cleaning and merging by name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _present(column: T.StructField):
    """Test for a value; NaN counts as missing."""
    c = F.col(f"`{column.name}`")
    if isinstance(column.dataType, (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def clean_table(
    df: DataFrame,
    remove_empty_rows: bool = True,
    remove_empty_cols: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Drop records, then columns, that hold no value at all.

    Columns in `keep` (keys, provenance) neither save an empty record nor get
    dropped. Which columns are empty is a fact of the data, so it is found by
    one aggregate that returns a single record before the result is planned.
    """
    tested = [f for f in df.schema.fields if f.name not in keep]
    if remove_empty_rows and tested:
        df = df.where(reduce(lambda a, b: a | b, [_present(f) for f in tested]))
    if remove_empty_cols and tested:
        filled = df.agg(
            *[F.coalesce(F.bool_or(_present(f)), F.lit(False)).alias(f.name) for f in tested]
        ).first()
        df = df.drop(*[f.name for f in tested if not filled[f.name]])
    return df


# Numeric types from narrow to wide, for columns that differ between inputs.
_WIDENING = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def _common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _WIDENING and type(b) in _WIDENING:
        wide = max(a, b, key=lambda t: _WIDENING.index(type(t)))
        if isinstance(wide, T.FloatType):
            return T.DoubleType()
        return wide
    return T.StringType()


def merge_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union with columns matched by name, missing ones null, in first-seen order.

    A column whose type differs between inputs becomes the wider number, or
    text when there is none.
    """
    types: dict[str, T.DataType] = {}
    for frame in frames:
        for f in frame.schema.fields:
            types[f.name] = _common_type(types.get(f.name, f.dataType), f.dataType)
    cast = [
        frame.select(
            *[F.col(f"`{f.name}`").cast(types[f.name]).alias(f.name) for f in frame.schema.fields]
        )
        for frame in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)
