import random

import pytest
from pyspark.sql import functions as F

from sheetgrid.operators import extract as ex
from sheetgrid.plans.rules import BOM, QUOTATION, SALES, SDM, only

FILE = ("book.xlsx", "S1")


def records(df):
    return sorted((r.label, r.value, r.row, r.column) for r in df.collect())


def row_maps(df):
    return sorted((r.row, dict(r.cells)) for r in df.collect())


def of(grid, template, data_type, rows, **options):
    found = ex.extract(grid({FILE: rows}), [only(template, [data_type])], **options)
    shape = next(r.shape for r in template.rules if r.data_type == data_type)
    return row_maps(found.row_maps) if shape == "after" else records(found.records)


def test_sdm_company_in_the_first_ten_rows_only(grid):
    rows = {
        1: [None, None, "Industrial Acura SA"],
        9: ["INDUSTRIAL ACURA"],
        10: ["INDUSTRIAL ACURA"],
    }
    assert of(grid, SDM, "company_info", rows) == [
        ("company_name", "INDUSTRIAL ACURA", 10, 1),
        ("company_name", "Industrial Acura SA", 2, 3),
    ]


def test_sdm_dates_look_two_columns_either_way(grid):
    rows = {3: ["a", "b", "c", "Fecha", "d", "e", "f"]}
    assert of(grid, SDM, "dates", rows) == [
        ("Fecha", "Fecha", 4, 4),
        ("Fecha", "b", 4, 2),
        ("Fecha", "c", 4, 3),
        ("Fecha", "d", 4, 5),
        ("Fecha", "e", 4, 6),
    ]


def test_labels_at_the_edges_are_clipped(grid):
    rows = {0: ["FECHA", None, "x"], 1: [None, "y", None, "FECHA"]}
    want = [("FECHA", "FECHA", 1, 1), ("FECHA", "FECHA", 2, 4)]
    want += [("FECHA", "x", 1, 3), ("FECHA", "y", 2, 2)]
    assert of(grid, SDM, "dates", rows) == sorted(want)


def test_gaps_do_not_stretch_the_reach(grid):
    rows = {0: ["far", None, None, "FECHA", None, None, "far"]}
    assert of(grid, SDM, "dates", rows) == [("FECHA", "FECHA", 1, 4)]


def test_blank_neighbours_in_both_modes(grid):
    rows = {0: [0, " ", "FECHA", None, False], 1: [None, None, None, None, None, "w"]}
    skip = [("FECHA", "0", 1, 1), ("FECHA", "FECHA", 1, 3), ("FECHA", "False", 1, 5)]
    assert of(grid, SDM, "dates", rows) == sorted(skip)
    nan = [("FECHA", "FECHA", 1, 3), ("FECHA", "nan", 1, 4)]
    assert of(grid, SDM, "dates", rows, blank="nan") == sorted(nan)


def test_nan_mode_is_clipped_to_the_sheet_width(grid):
    rows = {0: [None, "FECHA"], 5: ["x", "y", "z"]}
    want = [("FECHA", "FECHA", 1, 2), ("FECHA", "nan", 1, 1), ("FECHA", "nan", 1, 3)]
    assert of(grid, SDM, "dates", rows, blank="nan") == sorted(want)


def test_unknown_blank_mode(grid):
    with pytest.raises(ValueError):
        ex.near(grid({FILE: {0: ["a"]}}), ["a"], blank="other")


def test_specifications_start_after_the_first_anchor(grid):
    rows = {
        0: ["title"],
        19: ["x", "la fecha"],
        20: ["a", None, " ", 0],
        21: [" "],
        22: ["FECHA"],
    }
    assert of(grid, SDM, "specifications", rows) == [
        (21, {"col_0": "a", "col_3": "0"}),
        (23, {"col_0": "FECHA"}),
    ]


def test_anchor_beyond_the_first_twenty_rows_is_not_found(grid):
    assert of(grid, SDM, "specifications", {20: ["FECHA"], 21: ["a"]}) == []


def test_quotation_format_cell_is_not_a_folio(grid):
    rows = {
        0: ["Formato de Cotización - Folio", 7],
        2: ["FOLIO", None, 123],
    }
    assert of(grid, QUOTATION, "quotation_details", rows) == [
        ("folio", "123", 3, 3),
        ("folio", "FOLIO", 3, 1),
        ("quotation_format", "Formato de Cotización - Folio", 1, 1),
    ]


def test_design_codes_with_and_without_accent(grid):
    rows = {0: ["código de diseño", "A1"], 1: ["CODIGO DE DISEÑO", "A2"], 2: ["DISEÑO", "A3"]}
    assert of(grid, QUOTATION, "design_codes", rows) == [
        ("design_code", "A1", 1, 2),
        ("design_code", "A2", 2, 2),
        ("design_code", "CODIGO DE DISEÑO", 2, 1),
        ("design_code", "código de diseño", 1, 1),
    ]


def test_quotation_company_and_client(grid):
    rows = {1: ["Industrial Acura"], 2: ["Cliente", "ACME"]}
    assert of(grid, QUOTATION, "company_info", rows) == [
        ("company_name", "Industrial Acura", 2, 1)
    ]
    assert of(grid, QUOTATION, "client_info", rows) == [
        ("Cliente", "ACME", 3, 2),
        ("Cliente", "Cliente", 3, 1),
    ]


BOM_ROWS = {
    0: ["NO. DE PARTIDA", "PART NUMBER / NP", "DESCRIPCIÓN", "CANTIDAD"],
    1: [1, "P-1", "tornillo", 10],
    2: [2, None, "tuerca", 0],
    3: [3, "P-3", " ", "QTY / QUANTITY"],
    5: [None, None, None, 30],
}


def test_bom_materials_are_sparse_rows(grid):
    assert of(grid, BOM, "materials", BOM_ROWS) == [
        (2, {"col_0": "1", "col_1": "P-1", "col_2": "tornillo", "col_3": "10"}),
        (3, {"col_0": "2", "col_2": "tuerca", "col_3": "0"}),
        (4, {"col_0": "3", "col_1": "P-3", "col_3": "QTY / QUANTITY"}),
        (6, {"col_3": "30"}),
    ]


def test_bom_stacked_labels_both_emit_what_is_below(grid):
    assert of(grid, BOM, "quantities", BOM_ROWS) == [
        ("CANTIDAD", "0", 3, 4),
        ("CANTIDAD", "10", 2, 4),
        ("CANTIDAD", "30", 6, 4),
        ("CANTIDAD", "QTY / QUANTITY", 4, 4),
        ("QTY / QUANTITY", "30", 6, 4),
    ]


def test_bom_descriptions_and_part_numbers(grid):
    assert of(grid, BOM, "descriptions", BOM_ROWS) == [
        ("DESCRIPCIÓN", "tornillo", 2, 3),
        ("DESCRIPCIÓN", "tuerca", 3, 3),
    ]
    assert of(grid, BOM, "part_numbers", BOM_ROWS) == [
        ("NO. DE PARTIDA", "1", 2, 1),
        ("NO. DE PARTIDA", "2", 3, 1),
        ("NO. DE PARTIDA", "3", 4, 1),
        ("PART NUMBER / NP", "P-1", 2, 2),
        ("PART NUMBER / NP", "P-3", 4, 2),
    ]


def test_sales_extractors(grid):
    rows = {
        0: ["Nombre del cliente", "ACME"],
        1: ["Nombre del proyecto", "P1"],
        2: ["Nombre del vendedor", "V1"],
        3: ["Fecha requerida", "d1"],
        4: ["Fecha de solicitud", "d2"],
        5: ["Fecha de cotización", "d3"],
        6: ["Fecha", "d4"],
    }
    assert [v for _, v, _, c in of(grid, SALES, "client_info", rows) if c == 2] == ["ACME"]
    assert [v for _, v, _, c in of(grid, SALES, "project_info", rows) if c == 2] == ["P1"]
    assert [v for _, v, _, c in of(grid, SALES, "vendor_info", rows) if c == 2] == ["V1"]
    assert sorted(v for _, v, _, c in of(grid, SALES, "dates", rows) if c == 2) == ["d1", "d2", "d3"]


def test_numbers_are_never_labels_but_can_anchor(grid):
    g = grid({FILE: {0: [13127, "x"], 1: ["y"]}})
    assert records(ex.near(g, ["13127"])) == []
    assert row_maps(ex.after(g, ["13127"])) == [(2, {"col_0": "y"})]


def test_sheets_and_files_are_kept_apart(grid):
    g = grid({("a", "s"): {0: ["QTY"]}, ("a", "t"): {1: ["x"]}, ("b", "s"): {1: ["y"]}})
    assert records(ex.below(g, ["qty"])) == []


def test_as_table_uses_the_extractor_field_names(grid):
    rule = next(r for r in SALES.rules if r.data_type == "vendor_info")
    g = grid({FILE: {0: ["Nombre del vendedor", "V"]}})
    table = ex.as_table(ex.extract(g, [SALES]).records, rule, SALES)
    assert table.columns == [
        "source_file",
        "sheet_name",
        "field_type",
        "vendor_value",
        "row",
        "column",
    ]


def test_routes_restrict_rules_to_their_files(spark, grid):
    g = grid(
        {
            ("a", "s"): {0: ["FECHA", "1"], 1: ["CANTIDAD"], 2: [5]},
            ("b", "s"): {0: ["FECHA", "1"], 1: ["CANTIDAD"], 2: [5]},
        }
    )
    routes = spark.createDataFrame([("a", "sdm"), ("b", "bom")], "source_file string, template string")
    found = ex.extract(g, [SDM, BOM], routes, block_rows=2)
    assert {(r.source_file, r.template) for r in found.records.collect()} == {
        ("a", "sdm"),
        ("b", "bom"),
    }
    assert {r.source_file for r in found.row_maps.collect()} == {"a"}


def brute_below(rows, word):
    out = []
    for r, cells in rows.items():
        for c, v in enumerate(cells):
            if isinstance(v, str) and word in v.upper():
                for r2, cells2 in rows.items():
                    if r2 > r and c < len(cells2) and cells2[c] is not None:
                        if str(cells2[c]).strip():
                            out.append((v, str(cells2[c]), r2 + 1, c + 1))
    return sorted(out)


def brute_near(rows, word):
    out = []
    for r, cells in rows.items():
        for c, v in enumerate(cells):
            if isinstance(v, str) and word in v.upper():
                for c2 in range(max(c - 2, 0), min(c + 3, len(cells))):
                    if cells[c2] is not None and str(cells[c2]).strip():
                        out.append((v, str(cells[c2]), r + 1, c2 + 1))
    return sorted(out)


def brute_after(rows, word):
    hits = [r for r, cells in rows.items() if r < 20 and any(word in str(v).upper() for v in cells if v is not None)]
    if not hits:
        return []
    out = []
    for r, cells in rows.items():
        kept = {f"col_{c}": str(v) for c, v in enumerate(cells) if v is not None and str(v).strip()}
        if r > min(hits) and kept:
            out.append((r + 1, kept))
    return sorted(out, key=lambda x: x[0])


@pytest.mark.parametrize("seed", range(4))
def test_blocks_give_what_nested_loops_give(grid, seed):
    """Random sheets, one of them holding most rows, cut into blocks of 3 rows."""
    rng = random.Random(seed)
    values = ["Qty", "a", "x qty", " ", None, None, 0, 7, "b"]
    sheets = {}
    for name, n_rows in (("hot", 40), ("cold", 4), ("tiny", 1)):
        rows = rng.sample(range(60), n_rows)
        sheets[("f", name)] = {r: [rng.choice(values) for _ in range(rng.randint(1, 7))] for r in sorted(rows)}
    g = grid(sheets)
    for op, brute in ((ex.below, brute_below), (ex.near, brute_near)):
        got = op(g, ["QTY"], block_rows=3)
        for (_, name), rows in sheets.items():
            assert records(got.where(F.col("sheet_name") == name)) == brute(rows, "QTY")
    got = ex.after(g, ["QTY"], block_rows=3)
    for (_, name), rows in sheets.items():
        assert row_maps(got.where(F.col("sheet_name") == name)) == brute_after(rows, "QTY")


def test_row_numbers_may_have_gaps_of_any_size(grid):
    far = 10**15
    g = grid({FILE: {0: ["QTY"], 5: ["a"], far: ["QTY"], far + 1: ["b"]}})
    assert records(ex.below(g, ["QTY"])) == [
        ("QTY", "QTY", far + 1, 1),
        ("QTY", "a", 6, 1),
        ("QTY", "b", far + 2, 1),
        ("QTY", "b", far + 2, 1),
    ]
    assert [row for row, _ in row_maps(ex.after(g, ["QTY"]))] == [6, far + 1, far + 2]
