"""Extraction queries: the shapes on the document corpus, the templates on forms."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetgrid.model import SHEET_KEYS
from sheetgrid.operators import extract as ex
from sheetgrid.operators.grid import find_anchor, keyword_census
from sheetgrid.operators.route import route_templates
from sheetgrid.plans.rules import (
    AFTER,
    BELOW,
    BOM,
    BUILT_IN,
    NEAR,
    QUOTATION,
    SALES,
    SDM,
    SELF,
    Rule,
    Template,
    only,
)
from workload import shapes_sql as sql
from workload.data import (
    DOCUMENT_CELLS,
    FORMS,
    document_grid,
    form_cells_sql,
    form_grid,
    stored,
    table,
)

# Stand-ins for labels: words that occur in the documents.
LABEL = ("thor",)
CORPUS = Template(
    "corpus",
    rules=(
        Rule("openings", SELF, ("STION", "MENT"), max_row=10, label="opening"),
        Rule("beside", NEAR, ("THOR", "ÉTION")),
        Rule("codes", SELF, ("HAING",), label="code"),
        Rule("codes", NEAR, ("ING",), label="other_code", exclude=("HAING", "INGE")),
        Rule("under", BELOW, ("THER",)),
        Rule("rest", AFTER, ("EAU", "UNG"), max_row=20),
    ),
)
RECORD = [*SHEET_KEYS, "label", "value", "row", "column"]


def _entries(row_maps: DataFrame, *extra: str) -> DataFrame:
    return row_maps.select(*SHEET_KEYS, *extra, "row", F.explode("cells").alias("key", "value"))


def label_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.self_cells(document_grid(spark, sf_dir), LABEL).select(*SHEET_KEYS, "label", "value", "row", "column")


def label_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.near(document_grid(spark, sf_dir), LABEL).select(*RECORD)


def label_near_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.near(document_grid(spark, sf_dir), LABEL, blank="nan").select(*RECORD)


def label_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.below(document_grid(spark, sf_dir), LABEL).select(*RECORD)


def label_after_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(ex.after(document_grid(spark, sf_dir), LABEL))


def label_else_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = only(CORPUS, ["codes"])
    return ex.extract(document_grid(spark, sf_dir), [codes]).records.select(*RECORD)


def rules_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All record rules of a template in one pass, as one table."""
    records = ex.extract(document_grid(spark, sf_dir), [CORPUS]).records
    return records.select(*ex.RECORD)


def rules_row_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    row_maps = ex.extract(document_grid(spark, sf_dir), [CORPUS]).row_maps
    return _entries(row_maps, "template", "data_type")


def first_anchor_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_anchor(document_grid(spark, sf_dir), LABEL)


def keyword_census_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_census(document_grid(spark, sf_dir), ("total", "part", "mat", "thor"))


# Routing over web addresses: folders stand in for sheet names.
URL_TEMPLATES = (
    Template("mobile", path_keywords=("//M.",), sheet_keywords=("DE",)),
    Template("blog", path_keywords=("BLOG", "//WWW"), sheet_keywords=("FR", "ES")),
    Template("secure", path_keywords=("HTTPS:",)),
)


def route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "pages").select(
        F.col("url").alias("source_file"),
        F.element_at(F.split("url", "/"), 4).alias("sheet_name"),
    )
    return route_templates(sheets, URL_TEMPLATES, match="path")


ROUTE_PAGES_SQL = """
SELECT source_file, CASE min(p) WHEN 0 THEN 'mobile' WHEN 1 THEN 'blog' WHEN 2 THEN 'secure' END
  AS template
FROM (SELECT url AS source_file,
        CASE WHEN contains(upper(url), '//M.') OR contains(upper(sheet), 'DE') THEN 0
             WHEN contains(upper(url), 'BLOG') OR contains(upper(url), '//WWW')
               OR contains(upper(sheet), 'FR') OR contains(upper(sheet), 'ES') THEN 1
             WHEN contains(upper(url), 'HTTPS:') THEN 2 END AS p
      FROM (SELECT url, string_split(url, '/')[4] AS sheet FROM pages))
GROUP BY source_file
"""


def all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = None
    for form in FORMS.values():
        piece = form_grid(spark, sf_dir, form)
        grid = piece if grid is None else grid.unionByName(piece)
    return grid


def route_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in routing of all forms, by file and sheet names."""
    return route_templates(all_forms(spark, sf_dir).select(*SHEET_KEYS).distinct(), BUILT_IN)


def routed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms in one grid; each file gives only its own template's records."""
    grid = stored(all_forms(spark, sf_dir))
    routes = route_templates(grid.select(*SHEET_KEYS).distinct(), BUILT_IN)
    return ex.extract(grid, BUILT_IN, routes).records


def routed_row_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = stored(all_forms(spark, sf_dir))
    routes = route_templates(grid.select(*SHEET_KEYS).distinct(), BUILT_IN)
    return _entries(ex.extract(grid, BUILT_IN, routes).row_maps, "template", "data_type")


def _form_sql(template: Template, body: str) -> str:
    return f"WITH {form_cells_sql(FORMS[template.name])}\n{body}"


def _template_records(template: Template, data_type: str, spark, sf_dir: str) -> DataFrame:
    grid = form_grid(spark, sf_dir, FORMS[template.name])
    return ex.extract(grid, [only(template, [data_type])]).records.select(*RECORD)


def _template_rows(template: Template, data_type: str, spark, sf_dir: str) -> DataFrame:
    grid = form_grid(spark, sf_dir, FORMS[template.name])
    return _entries(ex.extract(grid, [only(template, [data_type])]).row_maps)


def _forms_sql(per_form) -> str:
    """UNION ALL over the templates' forms of a query on `g`."""
    return "\nUNION ALL ".join(
        f"SELECT * FROM (WITH {form_cells_sql(FORMS[t.name])} {per_form(t)})"
        for t in (SDM, QUOTATION, BOM, SALES)
    )


_documents = f"WITH {DOCUMENT_CELLS}\n"
_near = Rule("near", NEAR, LABEL)

QUERIES = {
    "label_self": label_self,
    "label_near": label_near,
    "label_near_nan": label_near_nan,
    "label_below": label_below,
    "label_after_rows": label_after_rows,
    "label_else_branch": label_else_branch,
    "rules_extract_all": rules_extract_all,
    "rules_row_maps": rules_row_maps,
    "first_anchor_row": first_anchor_row,
    "keyword_census": keyword_census_top,
    "route_templates": route_pages,
    "route_forms": route_forms,
    "routed_extract": routed_extract,
    "routed_row_maps": routed_row_maps,
}

_codes = [r for r in CORPUS.rules if r.data_type == "codes"]
ORACLES = {
    "label_self": _documents + sql.records(Rule("self", SELF, LABEL)),
    "label_near": _documents + sql.records(_near),
    "label_near_nan": _documents + sql.near_with_nan(_near),
    "label_below": _documents + sql.records(Rule("below", BELOW, LABEL)),
    "label_after_rows": _documents + sql.entries(Rule("after", AFTER, LABEL, max_row=20)),
    "label_else_branch": _documents + "\nUNION ALL ".join(sql.records(r) for r in _codes),
    "rules_extract_all": _documents + sql.of_rules(CORPUS.rules, "corpus"),
    "rules_row_maps": _documents
    + f"SELECT source_file, sheet_name, 'corpus' AS template, 'rest' AS data_type,"
    f' "row", "key", value FROM ({sql.entries(CORPUS.rules[-1])})',
    "first_anchor_row": _documents
    + 'SELECT source_file, sheet_name, cast(min("row") AS bigint) AS anchor_row FROM g'
    " WHERE \"row\" < 20 AND contains(upper(value), 'THOR') GROUP BY ALL",
    "keyword_census": _documents
    + "SELECT DISTINCT source_file, sheet_name, value FROM g WHERE \"row\" < 10 AND ("
    + " OR ".join(f"contains(lower(value), '{k}')" for k in ("total", "part", "mat", "thor"))
    + ")",
    "route_templates": ROUTE_PAGES_SQL,
    "route_forms": _forms_sql(
        lambda t: f"SELECT DISTINCT source_file, '{t.name}' AS template FROM g"
    ),
    "routed_extract": _forms_sql(
        lambda t: sql.of_rules([r for rules in sql.LITERAL[t.name].values() for r in rules], t.name)
    ),
    "routed_row_maps": "\nUNION ALL ".join(
        f"SELECT source_file, sheet_name, '{t.name}' AS template, '{r.data_type}' AS data_type,"
        f' "row", "key", value FROM (WITH {form_cells_sql(FORMS[t.name])} {sql.entries(r)})'
        for t in (SDM, BOM)
        for r in t.rules
        if r.shape == AFTER
    ),
}

# One query per built-in extractor; the SQL has its own keywords.
for _template in (SDM, QUOTATION, BOM, SALES):
    for _data_type, _rules in sql.LITERAL[_template.name].items():
        _name = f"{_template.name}_{_data_type}"
        if _rules[0].shape == AFTER:
            QUERIES[_name] = partial(_template_rows, _template, _data_type)
            ORACLES[_name] = _form_sql(_template, sql.entries(_rules[0]))
        else:
            QUERIES[_name] = partial(_template_records, _template, _data_type)
            ORACLES[_name] = _form_sql(
                _template, "\nUNION ALL ".join(sql.records(r) for r in _rules)
            )
