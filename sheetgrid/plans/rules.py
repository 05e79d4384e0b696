"""Templates as data: which workbooks they own and what they extract.

A new template is a new `Template` value; no code is loaded by name.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

# Extensions, in upper case, of the files a template for any workbook takes.
WORKBOOK_EXTENSIONS = (".XLSX", ".XLS")

SELF, NEAR, BELOW, AFTER = "self", "near", "below", "after"

# Depth of the search for a label or anchor, in rows from the top of the sheet.
TOP_ROWS_COMPANY = 10
TOP_ROWS_ANCHOR = 20


@dataclass(frozen=True)
class Rule:
    """One extractor.

    keywords   case-insensitive; a cell matches once however many it contains
    exclude    a cell containing one of these is left to another rule
    max_row    only labels above this row count; None for the whole sheet
    label      text for the label field; None emits the label cell's own text
    fields     names of the label and value fields when written as a table
    """

    data_type: str
    shape: str
    keywords: tuple[str, ...]
    max_row: int | None = None
    label: str | None = None
    exclude: tuple[str, ...] = ()
    fields: tuple[str, str] = ("type", "value")


@dataclass(frozen=True)
class Schema:
    """Expectations on an extracted or tabular data set."""

    required_columns: tuple[str, ...] = ()
    column_types: dict[str, str] = field(default_factory=dict)
    constraints: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class Template:
    """Routing keywords and extractors of one workbook family.

    `any_file` marks the template of last resort, which owns every workbook.
    """

    name: str
    path_keywords: tuple[str, ...] = ()
    sheet_keywords: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    any_file: bool = False
    schema: Schema = Schema()

    def owns(self, path: str, sheet_names: Sequence[str]) -> bool:
        """The path, or a sheet name, holds a keyword; one file at a time."""
        path = path.upper()
        if self.any_file and path.endswith(WORKBOOK_EXTENSIONS):
            return True
        return any(k.upper() in path for k in self.path_keywords) or any(
            k.upper() in name.upper() for k in self.sheet_keywords for name in sheet_names
        )


# Keywords, field names and row limits below are fixed values.
SDM = Template(
    name="sdm",
    path_keywords=("SDM",),
    sheet_keywords=("SDM", "13127"),
    rules=(
        Rule(
            "company_info", SELF, ("INDUSTRIAL ACURA",), TOP_ROWS_COMPANY, "company_name"
        ),
        Rule("dates", NEAR, ("FECHA",), fields=("date_type", "date_value")),
        Rule("specifications", AFTER, ("FECHA",), TOP_ROWS_ANCHOR),
    ),
)

QUOTATION = Template(
    name="quotation",
    path_keywords=("COTIZACION", "COTIZACIÓN", "QUOTATION"),
    sheet_keywords=("COTIZACION", "COTIZACIÓN", "QUOTATION"),
    rules=(
        Rule(
            "company_info", SELF, ("INDUSTRIAL ACURA",), TOP_ROWS_COMPANY, "company_name"
        ),
        Rule("client_info", NEAR, ("CLIENTE",), fields=("field_type", "client_value")),
        Rule(
            "quotation_details",
            SELF,
            ("FORMATO DE COTIZACIÓN",),
            label="quotation_format",
        ),
        Rule(
            "quotation_details",
            NEAR,
            ("FOLIO",),
            label="folio",
            exclude=("FORMATO DE COTIZACIÓN",),
        ),
        Rule(
            "design_codes",
            NEAR,
            ("CÓDIGO DE DISEÑO", "CODIGO DE DISEÑO"),
            label="design_code",
        ),
    ),
)

BOM = Template(
    name="bom",
    path_keywords=("BOM", "BILL OF MATERIAL", "LISTA DE MATERIALES"),
    sheet_keywords=("BOM", "MATERIAL", "MATERIALES"),
    rules=(
        Rule("materials", AFTER, ("PART NUMBER", "PARTIDA"), TOP_ROWS_ANCHOR),
        Rule(
            "quantities",
            BELOW,
            ("CANTIDAD", "QTY", "QUANTITY"),
            fields=("quantity_type", "quantity_value"),
        ),
        Rule(
            "descriptions",
            BELOW,
            ("DESCRIPCIÓN", "DESCRIPTION", "DESCRIPCION"),
            fields=("description_type", "description_value"),
        ),
        Rule(
            "part_numbers",
            BELOW,
            ("PART NUMBER", "PART NUMBER /", "NO. DE PARTIDA"),
            fields=("part_number_type", "part_number_value"),
        ),
    ),
)

SALES = Template(
    name="sales",
    path_keywords=("VENTAS", "SALES", "INFORME TECNICO", "TECHNICAL REPORT"),
    sheet_keywords=("VENTAS", "SALES", "INFORME", "REPORT"),
    rules=(
        Rule(
            "client_info",
            NEAR,
            ("NOMBRE DEL CLIENTE",),
            fields=("field_type", "client_value"),
        ),
        Rule(
            "project_info",
            NEAR,
            ("NOMBRE DEL PROYECTO",),
            fields=("field_type", "project_value"),
        ),
        Rule(
            "dates",
            NEAR,
            ("FECHA REQUERIDA", "FECHA DE SOLICITUD", "FECHA DE COTIZACIÓN"),
            fields=("date_type", "date_value"),
        ),
        Rule(
            "vendor_info",
            NEAR,
            ("NOMBRE DEL VENDEDOR",),
            fields=("field_type", "vendor_value"),
        ),
    ),
)

GENERIC = Template(name="generic", any_file=True)

# Priority order: the specific templates first, the one for any file last.
BUILT_IN = (SDM, QUOTATION, BOM, SALES, GENERIC)

# Words looked for by the keyword census; fixed values.
CENSUS_KEYWORDS = (
    "código",
    "codigo",
    "descripción",
    "descripcion",
    "cantidad",
    "precio",
    "total",
    "fecha",
    "cliente",
    "proveedor",
    "parte",
    "part number",
    "item",
    "material",
    "unidad",
    "costo",
)


def only(template: Template, data_types: Iterable[str]) -> Template:
    """The template with just these extractors switched on."""
    wanted = set(data_types)
    return replace(
        template, rules=tuple(r for r in template.rules if r.data_type in wanted)
    )


def owner(
    path: str, sheet_names: Sequence[str], templates: Sequence[Template], match: str = "name"
) -> str | None:
    """Name of the first template, in order, that owns a file; None for none."""
    tested = path if match == "path" else path.rpartition("/")[2]
    return next((t.name for t in templates if t.owns(tested, sheet_names)), None)


def rules_of_shape(
    templates: Sequence[Template], *shapes: str
) -> list[tuple[Template, Rule]]:
    return [(t, r) for t in templates for r in t.rules if r.shape in shapes]
