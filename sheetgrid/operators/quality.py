"""Type detection, column profiles and schema validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetgrid.functions.plans import pin_cells
from sheetgrid.functions.text import is_datetime_text, is_numeric_text, strip
from sheetgrid.model import BOOLEAN, DATETIME, NUMBER, SHEET_KEYS
from sheetgrid.plans.rules import Schema

# Detected types.
EMPTY, NUMERIC, DATE, BOOL, TEXT = "empty", "numeric", "datetime", "boolean", "string"


def _native(data_type: T.DataType) -> str | None:
    """Detected type that follows from a column's Spark type; None for text."""
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return None


def _field(f: T.StructField) -> Column:
    """The column with NaN as null."""
    column = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(column, F.lit(None).cast(f.dataType))
    return column


def _as_text(f: T.StructField) -> Column:
    """Text that is equal exactly for equal values."""
    column = _field(f)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return (column + F.lit(0.0)).cast("string")  # -0.0 equals 0.0
    if isinstance(f.dataType, T.BinaryType):
        return F.hex(column)
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def _label(any_value: Column, numeric: Column, date: Column, boolean: Column) -> Column:
    return (
        F.when(~any_value, EMPTY)
        .when(numeric, NUMERIC)
        .when(date, DATE)
        .when(boolean, BOOL)
        .otherwise(TEXT)
    )


def _detected(f: T.StructField) -> Column:
    """Aggregate: detected type of one column over a group."""
    native = _native(f.dataType)
    some = F.count(_field(f)) > 0
    if native is not None:
        return F.when(some, native).otherwise(EMPTY)
    if not isinstance(f.dataType, T.StringType):
        return F.when(some, TEXT).otherwise(EMPTY)
    value = F.col(f"`{f.name}`")
    return _label(
        some,
        F.bool_and(is_numeric_text(value)),
        F.bool_and(is_datetime_text(value)),
        F.lit(False),
    )


def _tall(name: str, columns: Sequence[str], values: Sequence[Column]) -> Column:
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), v.alias(name))
                for c, v in zip(columns, values)
            ]
        )
    )


def detect_types(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    sample: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """(column_name, detected_type) per column, and per group of `by`.

    Looks at all values, or with `sample` at the first so many non-null ones
    per column in the order of `order_by`, which should be total.
    """
    fields = [
        f
        for f in df.schema.fields
        if (f.name in columns if columns is not None else f.name not in by)
    ]
    names = [f.name for f in fields]
    if sample is None:
        one = df.groupBy(*by).agg(*[_detected(f).alias(f"_t{i}") for i, f in enumerate(fields)])
        return one.select(
            *by, _tall("detected_type", names, [F.col(f"_t{i}") for i in range(len(fields))])
        )
    if not order_by:
        raise ValueError("a sample of first values needs order_by")
    # Only text columns depend on which values are looked at; the others only
    # on whether there is one.
    natives = {f.name: _native(f.dataType) for f in fields}
    order = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)]
    tall = df.select(
        *by, *order, _tall("_text", names, [_as_text(f) for f in fields])
    ).where(F.col("_text").isNotNull())
    first = Window.partitionBy(*by, "column_name").orderBy(
        *[f"_o{i}" for i in range(len(order_by))]
    )
    known = F.lit(None).cast("string")
    for name, native in natives.items():
        if native is not None:
            known = F.when(F.col("column_name") == name, native).otherwise(known)
    seen = (
        tall.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= sample)
        .groupBy(*by, "column_name")
        .agg(
            _label(
                F.lit(True),
                F.bool_and(is_numeric_text(F.col("_text"))),
                F.bool_and(is_datetime_text(F.col("_text"))),
                F.lit(False),
            ).alias("_seen")
        )
    )
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    wanted = groups.select(*by, F.explode(F.array(*map(F.lit, names))).alias("column_name"))
    return wanted.join(seen, [*by, "column_name"], "left").select(
        *by,
        "column_name",
        F.when(F.col("_seen").isNull(), EMPTY)
        .otherwise(F.coalesce(known, F.col("_seen")))
        .alias("detected_type"),
    )


def first_cells(grid: DataFrame, n: int) -> DataFrame:
    """The first `n` cells of every column of every sheet, in row order, one record per cell.

    For n below 1,000 Spark keeps the first n of a column in each task before cells move, so of a sheet with a
    third of all rows n cells per column and task are shuffled.
    """
    down = Window.partitionBy(*SHEET_KEYS, "col").orderBy("row")
    cells = pin_cells(grid).select(*SHEET_KEYS, "row", F.inline("cells"))
    return cells.withColumn("_nth", F.row_number().over(down)).where(F.col("_nth") <= n).drop("_nth")


def detect_cell_types(grid: DataFrame, sample: int | None = None) -> DataFrame:
    """Detected type of every column of every sheet, from all its cells or from the first `sample`.

    Empty cells are absent and don't count; a column is a column of the sheet, whatever its header.
    """
    value, kind = F.col("value"), F.col("cell_type")
    number = (kind == NUMBER) | (kind == BOOLEAN) | is_numeric_text(value)
    date = (kind == DATETIME) | is_datetime_text(value)
    cells = pin_cells(grid).select(*SHEET_KEYS, F.inline("cells")) if sample is None else first_cells(grid, sample)
    return (
        cells.groupBy(*SHEET_KEYS, "col")
        .agg(
            F.when(F.bool_and(kind == BOOLEAN), BOOL)
            .otherwise(
                _label(F.lit(True), F.bool_and(number), F.bool_and(date), F.lit(False))
            )
            .alias("detected_type")
        )
    )


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column_name, dtype, null_count, unique_count) of every column.

    Exact counts turn each record into one (column, value) pair per column and
    count pairs, so the work grows linearly with the number of columns and
    repeated values are merged before the shuffle. `approx` needs no shuffle of
    values.
    """
    fields = df.schema.fields
    dtypes = F.create_map(
        *[F.lit(x) for i, f in enumerate(fields) for x in (i, f.dataType.simpleString())]
    )
    names = F.array(*[F.lit(f.name) for f in fields])
    if approx:
        counts = df.agg(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("_i"),
                        F.count_if(_field(f).isNull()).alias("null_count"),
                        F.approx_count_distinct(_as_text(f)).alias("unique_count"),
                    )
                    for i, f in enumerate(fields)
                ]
            ).alias("_counts")
        ).select(F.inline("_counts"))
    else:
        pairs = df.select(
            F.posexplode(F.array(*[_as_text(f) for f in fields])).alias("_i", "_v")
        )
        # Nulls form one group of their own per column.
        seen = pairs.groupBy("_i", "_v").agg(F.count(F.lit(1)).alias("_n")).groupBy("_i").agg(
            F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias(
                "null_count"
            ),
            F.count("_v").alias("unique_count"),
        )
        wanted = df.sparkSession.range(len(fields)).select(F.col("id").cast("int").alias("_i"))
        counts = wanted.join(seen, "_i", "left").na.fill(0, ["null_count", "unique_count"])
    return counts.select(
        F.get(names, F.col("_i")).alias("column_name"),
        dtypes[F.col("_i")].alias("dtype"),
        "null_count",
        "unique_count",
    )


VIOLATION = "struct<column:string,rule:string,expected:string,actual:string,message:string>"


def _violation(test: Column, column: str, rule: str, expected, actual: Column, message: Column):
    return F.when(
        F.coalesce(test, F.lit(False)),
        F.struct(
            F.lit(column).alias("column"),
            F.lit(rule).alias("rule"),
            F.lit(str(expected)).alias("expected"),
            actual.cast("string").alias("actual"),
            message.alias("message"),
        ),
    )


def duplicated_columns(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Columns holding some value (or null) more than once, per group of `by`.

    One pass for all columns; the key of the first grouping includes the value,
    so a large group is spread over tasks and repeats merge before the shuffle.
    """
    types = {f.name: f for f in df.schema.fields}
    pairs = df.select(
        *by, _tall("_value", columns, [_as_text(types[c]) for c in columns])
    )
    return (
        pairs.groupBy(*by, "column_name", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .groupBy(*by, "column_name")
        .agg(F.max("_n").alias("copies"))
    )


def check_schema(
    df: DataFrame, schema: Schema, by: Sequence[str] = (), keys: bool = False
) -> DataFrame:
    """Violations of a schema, one record each, per group of `by`.

    Missing columns, detected types and limits come from one aggregate; unique
    columns from one grouping by value. `dataset` joins the group's values; with `keys`
    they come as columns, too.
    """
    shown = list(by) if keys else []
    fields = {f.name: f for f in df.schema.fields}
    dataset = F.concat_ws("/", *by) if by else F.lit("")
    missing = [c for c in schema.required_columns if c not in fields]

    aggregates: list[Column] = []
    found: list[Column] = []
    if missing:
        found.append(
            _violation(
                F.lit(True),
                ", ".join(missing),
                "required",
                ", ".join(schema.required_columns),
                F.lit(", ".join(c for c in fields if c not in by)),
                F.lit(f"Missing required columns: {missing}"),
            )
        )
    for column, expected in schema.column_types.items():
        if column in fields:
            name = f"_type_{len(aggregates)}"
            aggregates.append(_detected(fields[column]).alias(name))
            found.append(
                _violation(
                    F.col(name) != expected,
                    column,
                    "type",
                    expected,
                    F.col(name),
                    F.concat(
                        F.lit(f"Column '{column}' has type '"),
                        F.col(name),
                        F.lit(f"' but expected '{expected}'"),
                    ),
                )
            )
    unique = []
    for column, limits in schema.constraints.items():
        if column not in fields:
            continue
        for rule, aggregate, where in (("min", F.min, "below minimum"), ("max", F.max, "above maximum")):
            if rule in limits:
                name = f"_{rule}_{len(aggregates)}"
                limit = limits[rule]
                value = _field(fields[column])
                if isinstance(fields[column].dataType, T.StringType) and not isinstance(limit, str):
                    # Cell text meets a number: text that is none has no place in the order.
                    value = value.try_cast("double")
                aggregates.append(aggregate(value).alias(name))
                outside = F.col(name) < F.lit(limit) if rule == "min" else F.col(name) > F.lit(limit)
                found.append(
                    _violation(
                        outside,
                        column,
                        rule,
                        limit,
                        F.col(name),
                        F.lit(f"Column '{column}' has values {where} {limit}"),
                    )
                )
        if limits.get("unique"):
            unique.append(column)

    parts = []
    if found:
        # A grouping without aggregates still yields one record per group.
        facts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
        if not by:
            facts = facts.where(F.col("_rows") > 0)
        parts.append(
            facts.select(
                *shown, dataset.alias("dataset"), F.inline(F.array_compact(F.array(*found)))
            )
        )
    if unique:
        message = F.concat(
            F.lit("Column '"),
            F.col("column_name"),
            F.lit("' has duplicate values but should be unique"),
        )
        parts.append(
            duplicated_columns(df, unique, by).select(
                *shown,
                dataset.alias("dataset"),
                F.col("column_name").alias("column"),
                F.lit("unique").alias("rule"),
                F.lit("unique").alias("expected"),
                F.concat(F.col("copies").cast("string"), F.lit(" copies")).alias("actual"),
                message.alias("message"),
            )
        )
    if not parts:
        none = df.sparkSession.createDataFrame(
            [],
            "dataset string, column string, rule string, expected string, actual string,"
            " message string",
        )
        named = [F.lit(None).cast(fields[k].dataType).alias(k) for k in shown]
        return none.select(*named, *none.columns)
    return reduce(DataFrame.unionByName, parts)


def validate(
    df: DataFrame,
    schema: Schema,
    by: Sequence[str],
    expected: DataFrame | None = None,
) -> DataFrame:
    """Violations of every data set in `df`, empty ones included.

    Data sets are the groups of `by`. With `expected`, a table of the data sets
    there should be, those without a record are reported as empty.
    """
    found = check_schema(df, schema, by)
    if expected is None:
        return found
    return found.unionByName(empty_datasets(expected, df, by))


def empty_datasets(
    expected: DataFrame, present: DataFrame, by: Sequence[str], keys: bool = False
) -> DataFrame:
    """A violation for each data set of `expected` without a record in `present`."""
    dataset = F.concat_ws("/", *by)
    return (
        expected.select(*by)
        .distinct()
        .join(present.select(*by).distinct(), list(by), "left_anti")
        .select(
            *(by if keys else ()),
            dataset.alias("dataset"),
            F.lit(None).cast("string").alias("column"),
            F.lit("not_empty").alias("rule"),
            F.lit("at least one row").alias("expected"),
            F.lit("0").alias("actual"),
            F.concat(F.lit("Data set "), dataset, F.lit(" is empty")).alias("message"),
        )
    )


def missing_columns(grid: DataFrame, required: Sequence[str], header_row: int = 0) -> DataFrame:
    """Required names that a sheet's header row does not hold, one record each.

    The difference is taken within the header row; a sheet without one misses
    every name.
    """
    wanted = F.array(*[F.lit(name) for name in required])
    present = F.transform(F.col("cells.value"), strip)
    headers = grid.where(F.col("row") == header_row).select(
        *SHEET_KEYS, F.array_except(wanted, present).alias("_missing")
    )
    return (
        grid.select(*SHEET_KEYS)
        .distinct()
        .join(headers, SHEET_KEYS, "left")
        .select(*SHEET_KEYS, F.explode(F.coalesce("_missing", wanted)).alias("missing"))
    )
