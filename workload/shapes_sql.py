"""SQL that says what each extraction shape means, over cells `g`."""

from __future__ import annotations

from collections.abc import Sequence

from sheetgrid.plans.rules import AFTER, BELOW, NEAR, SELF, Rule

# What each extractor looks for, by template and data type: fixed values, written out here so that
# a slip in the engine's own rules does not pass unnoticed.
LITERAL = {
    "sdm": {
        "company_info": [Rule("company_info", SELF, ("INDUSTRIAL ACURA",), 10, "company_name")],
        "dates": [Rule("dates", NEAR, ("FECHA",))],
        "specifications": [Rule("specifications", AFTER, ("FECHA",), 20)],
    },
    "quotation": {
        "company_info": [Rule("company_info", SELF, ("INDUSTRIAL ACURA",), 10, "company_name")],
        "client_info": [Rule("client_info", NEAR, ("CLIENTE",))],
        "quotation_details": [
            Rule("quotation_details", SELF, ("FORMATO DE COTIZACIÓN",), None, "quotation_format"),
            Rule("quotation_details", NEAR, ("FOLIO",), None, "folio", ("FORMATO DE COTIZACIÓN",)),
        ],
        "design_codes": [Rule("design_codes", NEAR, ("CÓDIGO DE DISEÑO", "CODIGO DE DISEÑO"), None, "design_code")],
    },
    "bom": {
        "materials": [Rule("materials", AFTER, ("PART NUMBER", "PARTIDA"), 20)],
        "quantities": [Rule("quantities", BELOW, ("CANTIDAD", "QTY", "QUANTITY"))],
        "descriptions": [Rule("descriptions", BELOW, ("DESCRIPCIÓN", "DESCRIPTION", "DESCRIPCION"))],
        "part_numbers": [Rule("part_numbers", BELOW, ("PART NUMBER", "PART NUMBER /", "NO. DE PARTIDA"))],
    },
    "sales": {
        "client_info": [Rule("client_info", NEAR, ("NOMBRE DEL CLIENTE",))],
        "project_info": [Rule("project_info", NEAR, ("NOMBRE DEL PROYECTO",))],
        "dates": [Rule("dates", NEAR, ("FECHA REQUERIDA", "FECHA DE SOLICITUD", "FECHA DE COTIZACIÓN"))],
        "vendor_info": [Rule("vendor_info", NEAR, ("NOMBRE DEL VENDEDOR",))],
    },
}

KEYS = "source_file, sheet_name"
RECORD = f'{KEYS}, label, value, "row", "column"'


def _has(column: str, keywords: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(upper({column}), '{k.upper()}')" for k in keywords) + ")"


def labels(rule: Rule) -> str:
    test = f"cell_type = 'string' AND {_has('value', rule.keywords)}"
    if rule.exclude:
        test += f" AND NOT {_has('value', rule.exclude)}"
    if rule.max_row is not None:
        test += f' AND "row" < {rule.max_row}'
    return f"SELECT * FROM g WHERE {test}"


def records(rule: Rule) -> str:
    """Records of a SELF, NEAR or BELOW rule."""
    label = "l.value" if rule.label is None else f"'{rule.label}'"
    join = {
        SELF: 'v."row" = l."row" AND v.col = l.col',
        NEAR: 'v."row" = l."row" AND v.col BETWEEN l.col - 2 AND l.col + 2',
        BELOW: 'v.col = l.col AND v."row" > l."row"',
    }[rule.shape]
    return f"""SELECT v.source_file, v.sheet_name, {label} AS label, v.value,
      cast(v."row" + 1 AS bigint) AS "row", cast(v.col + 1 AS integer) AS "column"
    FROM ({labels(rule)}) l JOIN g v
      ON v.source_file = l.source_file AND v.sheet_name = l.sheet_name AND {join}
    WHERE trim(v.value) <> ''"""


def entries(rule: Rule) -> str:
    """Map entries of an AFTER rule, one per cell."""
    test = _has("value", rule.keywords)
    if rule.max_row is not None:
        test += f' AND "row" < {rule.max_row}'
    return f"""SELECT v.source_file, v.sheet_name, cast(v."row" + 1 AS bigint) AS "row",
      'col_' || cast(v.col AS varchar) AS "key", v.value
    FROM g v JOIN (SELECT {KEYS}, min("row") AS anchor FROM g WHERE {test} GROUP BY ALL) a
      ON v.source_file = a.source_file AND v.sheet_name = a.sheet_name AND v."row" > a.anchor
    WHERE trim(v.value) <> ''"""


def near_with_nan(rule: Rule) -> str:
    """NEAR with absent neighbours as 'nan', clipped to the sheet's width."""
    return f"""SELECT l.source_file, l.sheet_name, l.value AS label,
      coalesce(v.value, 'nan') AS value, cast(l."row" + 1 AS bigint) AS "row",
      cast(l.col + o.d + 1 AS integer) AS "column"
    FROM ({labels(rule)}) l
    JOIN (SELECT {KEYS}, max(col) + 1 AS width FROM g GROUP BY ALL) w
      ON w.source_file = l.source_file AND w.sheet_name = l.sheet_name
    JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS d) o
      ON l.col + o.d >= 0 AND l.col + o.d < w.width
    LEFT JOIN g v ON v.source_file = l.source_file AND v.sheet_name = l.sheet_name
      AND v."row" = l."row" AND v.col = l.col + o.d
    WHERE v.value IS NULL
      OR CASE WHEN v.cell_type = 'number' THEN cast(v.value AS double) <> 0
              WHEN v.cell_type = 'boolean' THEN lower(v.value) = 'true'
              ELSE trim(v.value) <> '' END"""


def of_rules(rules: Sequence[Rule], template: str) -> str:
    """Records of several rules with their template and data type."""
    return "\nUNION ALL ".join(
        f"SELECT {KEYS}, '{template}' AS template, '{r.data_type}' AS data_type,"
        f' label, value, "row", "column" FROM ({records(r)})'
        for r in rules
        if r.shape != AFTER
    )
