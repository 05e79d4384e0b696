from pyspark.sql import functions as F

from sheetgrid.functions import text as tx
from sheetgrid.operators.quality import (
    check_schema,
    detect_cell_types,
    detect_types,
    duplicated_columns,
    missing_columns,
    profile,
    validate,
)
from sheetgrid.operators.route import route_templates
from sheetgrid.plans.rules import SDM, Schema, Template, only
from sheetgrid.sinks.names import clean_name


def one(spark, value, function):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(function(F.col("v"))).first()[0]


def test_strip_and_blank(spark):
    assert one(spark, "  a b \x1f", tx.strip) == "a b"
    values = {"a": True, " ": False, " ": False, "": False, "0": True, "\té": True, "漢": True,
              " x": True, "\x1f": False, " ": False, "É": True, None: False}
    for value, want in values.items():
        assert one(spark, value, tx.is_not_blank) is want, repr(value)


def test_names_match_their_python_twin(spark):
    names = {
        " Descripción Nº-1 (x)": "descripción_nº_1_x",
        "2024 Total": "col_2024_total",
        "": "unnamed_column",
        "()": "unnamed_column",
        "A b": "a_b",
        "a-b": "a_b",
        "_x": "col__x",
        "Ünï côde": "ünï_côde",
        "²": "col_²",
    }
    for name, want in names.items():
        assert one(spark, name, tx.clean_column_name) == want
        assert clean_name(name) == want


def test_table_names(spark):
    names = {
        "Hoja 1": "hoja_1",
        "Lista-de Precios": "lista_de_precios",
        "13127": "table_13127",
        "(!)": "dataframe_0",
        "_x": "table__x",
        None: "dataframe_0",
    }
    for name, want in names.items():
        assert one(spark, name, tx.clean_table_name) == want


def test_numeric_and_datetime_texts(spark):
    numeric = {"1": True, " 2.5 ": True, "-.5e3": True, "inf": True, "1d": False, "a": False, "": False,
               "1,000": False}
    for value, want in numeric.items():
        assert one(spark, value, tx.is_numeric_text) is want, value
    dates = {"2024-01-05": True, "2024-01-05 10:30": True, "2024-01-05T10:30:00Z": True,
             "2024/1/5": True, "1/31/2024": True, "2024": False, "2024-13-01": False, "x": False,
             "13/13/2024": False}
    for value, want in dates.items():
        assert one(spark, value, tx.is_datetime_text) is want, value


def detected(df, **options):
    return {r.column_name: r.detected_type for r in detect_types(df, **options).collect()}


def test_detect_types(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-05", True, "true", None, "1"), ("2.5", "2024-02-01", None, "false", None, "x")],
        "n string, d string, b boolean, t string, e string, m string",
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).withColumn("i", F.lit(1))
    want = {"n": "numeric", "d": "datetime", "b": "boolean", "t": "string", "e": "empty",
            "m": "string", "ts": "datetime", "i": "numeric"}
    assert detected(df) == want


def test_detect_types_of_a_first_sample(spark):
    df = spark.range(300).select(
        "id",
        F.when(F.col("id") < 150, F.col("id").cast("string")).otherwise("x").alias("late"),
        F.when(F.col("id") >= 200, "x").alias("gap"),
        F.lit(None).cast("string").alias("none"),
        F.lit(True).alias("flag"),
    )
    got = detected(df, sample=100, order_by=["id"])
    assert got == {"id": "numeric", "late": "numeric", "gap": "string", "none": "empty", "flag": "boolean"}
    assert detected(df)["late"] == "string"


def test_detect_cell_types(grid):
    rows = {0: [1, True, True, "2024-01-01", "a", "7"], 1: [2, False, 0, "2024-01-02", 5, "8.5"]}
    got = {r.col: r.detected_type for r in detect_cell_types(grid({("f", "s"): rows})).collect()}
    assert got == {0: "numeric", 1: "boolean", 2: "numeric", 3: "datetime", 4: "string", 5: "numeric"}


def test_profile_counts_nan_as_null_and_zero_once(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 0.0D, 'a', array(1)), (2, -0.0D, 'a', array(1)),"
        " (null, double('NaN'), null, null) t(i, d, s, l)"
    )
    want = {"i": ("int", 1, 2), "d": ("double", 1, 1), "s": ("string", 1, 1), "l": ("array<int>", 1, 1)}
    for approx in (False, True):
        got = {r.column_name: (r.dtype, r.null_count, r.unique_count) for r in profile(df, approx).collect()}
        assert got == want


def test_profile_of_an_empty_table(spark):
    got = profile(spark.createDataFrame([], "a int, b string")).collect()
    assert sorted((r.column_name, r.null_count, r.unique_count) for r in got) == [("a", 0, 0), ("b", 0, 0)]


SCHEMA = Schema(
    required_columns=("k", "gone"),
    column_types={"v": "numeric", "k": "string"},
    constraints={"v": {"min": 0, "max": 10}, "k": {"unique": True}, "u": {"unique": True}},
)


def test_check_schema_messages(spark):
    df = spark.createDataFrame(
        [("a", -1, None), ("a", 11, None), ("b", 5, 1)], "k string, v int, u int"
    )
    got = sorted((r.column, r.rule, r.actual, r.message) for r in check_schema(df, SCHEMA).collect())
    assert got == [
        ("gone", "required", "k, v, u", "Missing required columns: ['gone']"),
        ("k", "unique", "2 copies", "Column 'k' has duplicate values but should be unique"),
        ("u", "unique", "2 copies", "Column 'u' has duplicate values but should be unique"),
        ("v", "max", "11", "Column 'v' has values above maximum 10"),
        ("v", "min", "-1", "Column 'v' has values below minimum 0"),
    ]


def test_check_schema_by_group_and_empty_data_sets(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 20)], "g string, v int")
    schema = Schema(column_types={"v": "string"}, constraints={"v": {"max": 10, "unique": True}})
    expected = spark.createDataFrame([("x",), ("z",)], "g string")
    got = sorted((r.dataset, r.rule) for r in validate(df, schema, ["g"], expected).collect())
    assert got == [("x", "type"), ("x", "unique"), ("y", "max"), ("y", "type"), ("z", "not_empty")]


def test_an_empty_schema_finds_nothing(spark):
    assert check_schema(spark.range(3), Schema()).collect() == []


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a int, b int")
    assert [tuple(r) for r in duplicated_columns(df, ["a", "b"]).collect()] == [("a", 2)]


def test_missing_columns_per_sheet(grid):
    g = grid(
        {
            ("f", "s"): {0: [" a ", "b"], 1: ["c"]},
            ("f", "t"): {0: ["a"]},
            ("f", "u"): {3: ["a"]},
        }
    )
    got = sorted(map(tuple, missing_columns(g, ["a", "b", "c"]).collect()))
    want = [("f", "s", "c"), ("f", "t", "b"), ("f", "t", "c")]
    assert got == want + [("f", "u", c) for c in "abc"]


def routes(spark, sheets, **options):
    df = spark.createDataFrame(sheets, "source_file string, sheet_name string")
    return {r.source_file: r.template for r in route_templates(df, **options).collect()}


def test_every_routing_keyword(spark):
    names = {
        "sdm-1.xlsx": "sdm",
        "Cotizacion 5.xlsx": "quotation",
        "COTIZACIÓN.xlsx": "quotation",
        "quotation.xlsx": "quotation",
        "bom.xlsx": "bom",
        "Bill of Materials.xlsx": "bom",
        "lista de materiales.xlsx": "bom",
        "ventas.xlsx": "sales",
        "Sales.xlsx": "sales",
        "informe tecnico.xlsx": "sales",
        "technical report.xlsx": "sales",
        "other.XLSX": "generic",
        "old.xls": "generic",
        "notes.txt": None,
    }
    assert routes(spark, [(n, "Hoja1") for n in names]) == names
    sheets = {
        "13127": "sdm",
        "Cotización": "quotation",
        "Materiales": "bom",
        "Material": "bom",
        "Informe": "sales",
        "Report 2": "sales",
        "Hoja1": "generic",
    }
    got = routes(spark, [(f"{i}.xlsx", s) for i, s in enumerate(sheets)])
    assert list(dict(sorted(got.items())).values()) == list(sheets.values())


def test_both_forms_of_routing_agree(spark):
    from sheetgrid.plans.rules import BUILT_IN, owner

    sheets = [("a/sdm.xlsx", "x"), ("sdm/b.xlsx", "BOM 1"), ("c.xls", "Cotización"), ("d.txt", "z"),
              ("bom/e.xlsx", "q"), ("f.XLSX", "ventas"), ("g.csv", "Materiales"), ("ß.xlsx", "ß")]
    for match in ("name", "path"):
        want = {f: owner(f, [s], BUILT_IN, match) for f, s in sheets}
        assert routes(spark, sheets, match=match) == want


def test_first_template_wins_over_all_sheets(spark):
    both = [("x.xlsx", "BOM"), ("x.xlsx", "Hoja"), ("x.xlsx", "SDM")]
    assert routes(spark, both) == {"x.xlsx": "sdm"}


def test_folders_count_only_when_matching_paths(spark):
    sheets = [("file:/sales/x.xlsx", "Hoja1")]
    assert routes(spark, sheets) == {"file:/sales/x.xlsx": "generic"}
    assert routes(spark, sheets, match="path") == {"file:/sales/x.xlsx": "sales"}


def test_a_template_is_data(spark):
    mine = Template("mine", path_keywords=("zz",))
    assert routes(spark, [("ZZ.xlsx", "s")], templates=[mine]) == {"ZZ.xlsx": "mine"}
    assert [r.data_type for r in only(SDM, ["dates"]).rules] == ["dates"]


def test_cell_types_of_the_first_cells(spark, grid):
    from sheetgrid.operators.quality import detect_cell_types, first_cells

    rows = {i: ["1" if i < 7 else "x", "a" if i == 5 else None, " ", True] for i in range(9)}
    rows[2] = ["2024-01-05", None, None, None]
    sheets = grid({("f", "S"): rows, ("f", "T"): {0: ["x"], 4: ["2"]}})
    types = lambda n: {(r.sheet_name, r.col): r.detected_type for r in detect_cell_types(sheets, n).collect()}
    assert types(2) == {("S", 0): "numeric", ("S", 1): "string", ("S", 2): "string", ("S", 3): "boolean", ("T", 0): "string"}
    assert types(3)["S", 0] == "string"  # the date is the third cell
    assert types(1)["T", 0] == "string" and types(1000) == types(None)
    # The rows of the first two cells of each column, empty ones not counted.
    got = sorted((r.sheet_name, r.col, r.row) for r in first_cells(sheets, 2).collect())
    assert got == [
        ("S", 0, 0), ("S", 0, 1), ("S", 1, 5), ("S", 2, 0), ("S", 2, 1), ("S", 3, 0), ("S", 3, 1), ("T", 0, 0), ("T", 0, 4),
    ]
    assert first_cells(sheets.where("false"), 2).count() == 0
