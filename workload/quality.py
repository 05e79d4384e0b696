"""Quality queries: types, profiles, constraints, names, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetgrid.functions.text import clean_column_name, clean_table_name
from sheetgrid.operators.quality import (
    check_schema,
    detect_cell_types,
    detect_types,
    duplicated_columns,
    missing_columns,
    profile,
    validate,
)
from sheetgrid.operators.tables import merge_by_name
from sheetgrid.plans.rules import Schema
from sheetgrid.sinks.names import prepare_for_db
from sheetgrid.sources.views import grid_to_cells, table_to_grid
from workload.data import (
    DOCUMENT_CELLS,
    SALES_FORM,
    document_grid,
    form_cells_sql,
    form_grid,
    table,
)


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with every field as text, as a sheet without types would hold them."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority",
        F.when(F.col("o_totalprice") < 0, "x").alias("o_comment"),
    )


def detect_types_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_types(orders_text(spark, sf_dir))


def detect_types_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("late", F.col("value") > 50)
    return detect_types(events, by=["event_type"])


def detect_types_first100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types from the first 100 values in key order, for customers by segment."""
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_mktsegment",
        F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string"))
        .otherwise(F.col("c_name"))
        .alias("mixed"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.when(F.col("c_acctbal") < -1e9, F.col("c_name")).alias("nothing"),
    )
    return detect_types(
        customers,
        columns=["mixed", "nation", "nothing", "c_custkey"],
        by=["c_mktsegment"],
        sample=100,
        order_by=["c_custkey"],
    )


def detect_cell_types_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_cell_types(form_grid(spark, sf_dir, SALES_FORM))


def detect_cell_types_first100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types from the first 100 cells of every column, of events as a sheet per kind.

    Numbers turn to text late in the sheet, and a column is empty at first.
    """
    events = table(spark, sf_dir, "events").select(
        "event_type",
        "event_id",
        "user_id",
        F.when(F.col("event_id") < 450, F.col("user_id").cast("string")).otherwise(F.col("props")).alias("late"),
        F.when(F.col("event_id") > 500, F.date_format("ts", "yyyy-MM-dd")).alias("from"),
        F.when(F.col("event_id") % 90 == 0, F.col("props")).otherwise(F.col("user_id").cast("string")).alias("mixed"),
    )
    grid = table_to_grid(events, F.lit("events.xlsx"), "event_type", "event_id", ["user_id", "late", "from", "mixed"])
    return detect_cell_types(grid, sample=100)


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = profile(table(spark, sf_dir, "orders"))
    events = profile(table(spark, sf_dir, "events"))
    return (
        orders.withColumn("table_name", F.lit("orders"))
        .unionByName(events.withColumn("table_name", F.lit("events")))
        .withColumn("dtype", F.regexp_replace("dtype", "_ntz$", ""))
        .select("table_name", "column_name", "dtype", "null_count", "unique_count")
    )


def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(table(spark, sf_dir, "lineitem")).drop("dtype")


LINE_LIMITS = Schema(
    constraints={
        "l_quantity": {"min": 5, "max": 40},
        "l_discount": {"min": 0, "max": 1},
        "l_linenumber": {"max": 6},
    }
)


def constraint_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", *LINE_LIMITS.constraints
    )
    return check_schema(lines, LINE_LIMITS, by=["l_returnflag"]).select(
        "dataset", "column", "rule", "message"
    )


def constraint_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the orders table that is not unique, with its most copies."""
    orders = table(spark, sf_dir, "orders")
    return duplicated_columns(orders, orders.columns)


def constraint_unique_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicated_columns(
        table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey"], ["c_mktsegment"]
    )


def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document's first line should hold but does not."""
    return missing_columns(document_grid(spark, sf_dir), ["The", "de", "der"])


ORDER_SCHEMA = Schema(
    required_columns=("o_orderkey", "o_clerk"),
    column_types={"o_orderkey": "numeric", "o_orderpriority": "numeric"},
    constraints={
        "o_totalprice": {"min": 1000, "max": 499000},
        "o_orderkey": {"unique": True},
        "o_custkey": {"unique": True},
    },
)


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema checked on each order status, with one expected status absent."""
    orders = table(spark, sf_dir, "orders")
    expected = (
        orders.select(F.col("o_orderstatus"))
        .distinct()
        .unionByName(
            table(spark, sf_dir, "lineitem").select(
                F.col("l_returnflag").alias("o_orderstatus")
            ).distinct()
        )
    )
    return validate(orders, ORDER_SCHEMA, ["o_orderstatus"], expected).select(
        "dataset", "column", "rule", "message"
    )


def clean_names_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus as a column name and as a table name."""
    words = grid_to_cells(document_grid(spark, sf_dir)).select("value").distinct()
    return words.select(
        "value",
        clean_column_name(F.col("value")).alias("column_name"),
        clean_table_name(F.col("value")).alias("table_name"),
    )


def clean_names_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with spaces, dashes and leading digits, from order priorities and parts."""
    priorities = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"))
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("  "), F.col("p_name"), F.lit(" - "), F.col("p_brand")).alias("name")
    )
    return (
        priorities.unionByName(parts)
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("uses"))
        .select(
            "name",
            "uses",
            clean_column_name(F.col("name")).alias("column_name"),
            clean_table_name(F.col("name")).alias("table_name"),
        )
    )


def prepare_for_db_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("Time Stamp"),
        (F.col("value") > 50).alias("Is-High"),
        F.col("event_type").alias("1st type"),
        F.col("props").alias(" Props (raw) "),
    )
    return prepare_for_db(events)


def merge_by_name_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers under shared names; the rest stays null."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.col("s_suppkey").cast("int").alias("key"),
        F.col("s_nationkey").cast("long").alias("nation"),
        (F.col("s_acctbal") > 0).alias("solvent"),
    )
    return merge_by_name([customers, suppliers]).withColumn(
        "solvent", F.col("solvent").cast("string")
    )


# What the name rules mean, on a text expression without outer blanks.
def _kept(text: str) -> str:
    return rf"regexp_replace(translate({text}, ' -', '__'), '[^\p{{L}}\p{{N}}_]', '', 'g')"


def _column_sql(text: str) -> str:
    kept = _kept(f"trim({text})")
    return (
        f"CASE WHEN {kept} = '' THEN 'unnamed_column'"
        rf" WHEN regexp_matches({kept}, '^\p{{L}}') THEN lower({kept})"
        f" ELSE 'col_' || lower({kept}) END"
    )


def _table_sql(text: str) -> str:
    kept = _kept(f"lower({text})")
    return (
        f"CASE WHEN {kept} = '' THEN 'dataframe_0'"
        rf" WHEN regexp_matches({kept}, '^\p{{L}}') THEN {kept} ELSE 'table_' || {kept} END"
    )


_NUMERIC = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def _type_sql(value: str) -> str:
    return (
        f"CASE WHEN count({value}) = 0 THEN 'empty'"
        f" WHEN bool_and(regexp_matches({value}, {_NUMERIC})) THEN 'numeric'"
        f" WHEN bool_and(regexp_matches({value}, '^\\d{{4}}-\\d\\d?-\\d\\d?')"
        f" AND try_cast({value} AS timestamp) IS NOT NULL) THEN 'datetime' ELSE 'string' END"
    )


_orders_text = """(SELECT cast(o_orderkey AS varchar) AS o_orderkey,
  cast(cast(o_totalprice AS decimal(18,2)) AS varchar) AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
  CASE WHEN o_totalprice < 0 THEN 'x' END AS o_comment FROM orders)"""

_events_types = {
    "event_id": "numeric",
    "ts": "datetime",
    "user_id": "numeric",
    "value": "numeric",
    "props": "string",
    "late": "boolean",
}

_profile_types = {
    "orders": {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": None,
        "o_orderpriority": "string",
    },
    "events": {
        "event_id": "bigint",
        "ts": None,
        "user_id": "bigint",
        "event_type": "string",
        "value": "double",
        "props": "string",
    },
}


def _profile_sql(table_name: str, column: str, dtype: str | None) -> str:
    return (
        f"SELECT '{table_name}' AS table_name, '{column}' AS column_name,"
        f" '{dtype or 'timestamp'}' AS dtype,"
        f" count(*) - count({column}) AS null_count, count(DISTINCT {column}) AS unique_count"
        f" FROM {table_name}"
    )


def _copies_sql(table_name: str, columns: list[str], by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return "\nUNION ALL ".join(
        f"SELECT {lead}'{c}' AS column_name, max(n) AS copies FROM"
        f" (SELECT {lead}{c}, count(*) AS n FROM {table_name} GROUP BY {lead}{c})"
        f" WHERE n > 1 {'GROUP BY ' + by if by else 'HAVING count(*) > 0'}"
        for c in columns
    )


_LINE_CHECKS = [
    ("l_quantity", "min", "min(l_quantity) < 5", "below minimum 5"),
    ("l_quantity", "max", "max(l_quantity) > 40", "above maximum 40"),
    ("l_discount", "min", "min(l_discount) < 0", "below minimum 0"),
    ("l_discount", "max", "max(l_discount) > 1", "above maximum 1"),
    ("l_linenumber", "max", "max(l_linenumber) > 6", "above maximum 6"),
]

QUERIES = {
    "detect_types": detect_types_orders,
    "detect_types_native": detect_types_native,
    "detect_types_first100": detect_types_first100,
    "detect_cell_types": detect_cell_types_forms,
    "detect_cell_types_first100": detect_cell_types_first100,
    "profile_columns": profile_columns,
    "profile_lineitem": profile_lineitem,
    "constraint_minmax": constraint_minmax,
    "constraint_unique": constraint_unique,
    "constraint_unique_grouped": constraint_unique_customers,
    "required_columns": required_columns,
    "validation_report": validation_report,
    "clean_names": clean_names_words,
    "table_names": clean_names_columns,
    "prepare_for_db": prepare_for_db_events,
    "merge_by_name": merge_by_name_parties,
}

_lines = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount"
    " l_tax l_returnflag l_linestatus l_shipdate"
).split()
_mixed = """(SELECT c_mktsegment, c_custkey, row_number() OVER w AS k,
  CASE WHEN c_acctbal > 0 THEN cast(c_nationkey AS varchar) ELSE c_name END AS mixed,
  cast(c_nationkey AS varchar) AS nation FROM customer
  WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey))"""

ORACLES = {
    "detect_types": "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, {_type_sql(c)} AS detected_type FROM {_orders_text}"
        for c in ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_comment")
    ),
    "detect_types_native": "\nUNION ALL ".join(
        f"SELECT event_type, '{c}' AS column_name,"
        f" CASE WHEN count({'value' if c == 'late' else c}) = 0 THEN 'empty' ELSE '{t}' END"
        f" AS detected_type FROM events GROUP BY event_type"
        for c, t in _events_types.items()
    ),
    "detect_types_first100": "\nUNION ALL ".join(
        f"SELECT c_mktsegment, '{c}' AS column_name, {_type_sql(c)} AS detected_type"
        f" FROM {_mixed} WHERE k <= 100 GROUP BY c_mktsegment"
        for c in ("mixed", "nation")
    )
    + "\nUNION ALL SELECT c_mktsegment, 'c_custkey', 'numeric' FROM customer GROUP BY c_mktsegment"
    + "\nUNION ALL SELECT c_mktsegment, 'nothing', 'empty' FROM customer GROUP BY c_mktsegment",
    "detect_cell_types": f"WITH {form_cells_sql(SALES_FORM)}\n"
    + rf"""SELECT source_file, sheet_name, cast(col AS integer) AS col,
      CASE WHEN bool_and(cell_type = 'number' OR regexp_matches(value, {_NUMERIC})) THEN 'numeric'
           WHEN bool_and(cell_type = 'datetime' OR (regexp_matches(value, '^\d{{4}}-\d\d?-\d\d?')
             AND try_cast(value AS timestamp) IS NOT NULL)) THEN 'datetime'
           ELSE 'string' END AS detected_type
    FROM g GROUP BY source_file, sheet_name, col""",
    "detect_cell_types_first100": f"""
    WITH c AS (SELECT event_type, event_id, unnest([0, 1, 2, 3]) AS col, unnest([cast(user_id AS varchar),
        CASE WHEN event_id < 450 THEN cast(user_id AS varchar) ELSE props END,
        CASE WHEN event_id > 500 THEN strftime(ts, '%Y-%m-%d') END,
        CASE WHEN event_id % 90 = 0 THEN props ELSE cast(user_id AS varchar) END]) AS value FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY event_type, col ORDER BY event_id) AS nth FROM c
      WHERE value IS NOT NULL AND value <> '')
    SELECT 'events.xlsx' AS source_file, event_type AS sheet_name, cast(col AS integer) AS col,
      {_type_sql('value')} AS detected_type FROM k WHERE nth <= 100 GROUP BY event_type, col""",
    "profile_columns": "\nUNION ALL ".join(
        _profile_sql(t, c, d) for t, columns in _profile_types.items() for c, d in columns.items()
    ),
    "profile_lineitem": "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count,"
        f" count(DISTINCT {c}) AS unique_count FROM lineitem"
        for c in _lines
    ),
    "constraint_minmax": "\nUNION ALL ".join(
        f"""SELECT l_returnflag AS dataset, '{c}' AS "column", '{rule}' AS rule,
        'Column ''{c}'' has values {text}' AS message
        FROM lineitem GROUP BY l_returnflag HAVING {test}"""
        for c, rule, test, text in _LINE_CHECKS
    ),
    "constraint_unique": _copies_sql("orders", list(_profile_types["orders"])),
    "constraint_unique_grouped": _copies_sql(
        "customer", ["c_custkey", "c_name", "c_nationkey"], "c_mktsegment"
    ),
    "required_columns": f"WITH {DOCUMENT_CELLS}\n"
    + "\nUNION ALL ".join(
        f"""SELECT source_file, sheet_name, '{w}' AS missing FROM g
        GROUP BY source_file, sheet_name
        HAVING NOT bool_or("row" = 0 AND trim(value) = '{w}')"""
        for w in ("The", "de", "der")
    ),
    "validation_report": """
    SELECT o_orderstatus AS dataset, 'o_clerk' AS "column", 'required' AS rule,
      'Missing required columns: [''o_clerk'']' AS message FROM orders GROUP BY ALL
    UNION ALL SELECT o_orderstatus, 'o_orderpriority', 'type',
      'Column ''o_orderpriority'' has type ''string'' but expected ''numeric'''
      FROM orders GROUP BY ALL
    UNION ALL SELECT o_orderstatus, 'o_totalprice', 'min',
      'Column ''o_totalprice'' has values below minimum 1000'
      FROM orders GROUP BY o_orderstatus HAVING min(o_totalprice) < 1000
    UNION ALL SELECT o_orderstatus, 'o_totalprice', 'max',
      'Column ''o_totalprice'' has values above maximum 499000'
      FROM orders GROUP BY o_orderstatus HAVING max(o_totalprice) > 499000
    UNION ALL SELECT o_orderstatus, 'o_orderkey', 'unique',
      'Column ''o_orderkey'' has duplicate values but should be unique'
      FROM orders GROUP BY o_orderstatus HAVING count(*) > count(DISTINCT o_orderkey)
    UNION ALL SELECT o_orderstatus, 'o_custkey', 'unique',
      'Column ''o_custkey'' has duplicate values but should be unique'
      FROM orders GROUP BY o_orderstatus HAVING count(*) > count(DISTINCT o_custkey)
    UNION ALL SELECT DISTINCT l_returnflag, NULL, 'not_empty',
      'Data set ' || l_returnflag || ' is empty' FROM lineitem
      WHERE l_returnflag NOT IN (SELECT o_orderstatus FROM orders)
    """,
    "clean_names": f"WITH {DOCUMENT_CELLS}\n"
    + f"SELECT value, {_column_sql('value')} AS column_name, {_table_sql('value')} AS table_name"
    " FROM (SELECT DISTINCT value FROM g)",
    "table_names": f"""SELECT name, count(*) AS uses, {_column_sql('name')} AS column_name,
      {_table_sql('name')} AS table_name
    FROM (SELECT o_orderpriority AS name FROM orders
          UNION ALL SELECT '  ' || p_name || ' - ' || p_brand FROM part) GROUP BY name""",
    "prepare_for_db": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_stamp,
      cast(value > 50 AS integer) AS is_high, event_type AS col_1st_type, props AS props_raw
    FROM events""",
    "merge_by_name": """SELECT c_custkey AS "key", c_name AS name,
      cast(c_nationkey AS bigint) AS nation, c_mktsegment AS segment,
      cast(NULL AS varchar) AS solvent FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, cast(s_acctbal > 0 AS varchar)
      FROM supplier""",
}
