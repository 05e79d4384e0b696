"""Rules as a table: thousands of keywords matched through an index of character runs.

`extract` writes every keyword into its plan, which is right for the dozens that a few templates
have. Here rules are rows, and the plan is the same for any number of them:

* A keyword is found through one of its character runs (`GRAM` characters; all of it, if
  shorter): one that few keywords, or few values, have. Texts and keywords that share this run are
  compared with `contains`, so nothing is missed and nothing else is compared.
* Up to `NARROW` keywords, counted first, their index goes to every task, with each rule's other
  keywords: cells are judged where they lie, and nothing of the grid is shuffled.
* Beyond that the index stays a table. Equal cell texts are then one value, so a word that a third of
  all cells hold is looked at once, and matches go back to the cells by value; where one value makes
  the cells uneven, Spark splits them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetgrid.functions.plans import computed_once, pin_cells
from sheetgrid.model import SHEET_KEYS, STRING
from sheetgrid.operators.extract import REACH, _self_and_near
from sheetgrid.plans.rules import NEAR, SELF, Template

GRAM = 4
#: Keywords whose index is sent to every task, some 10 MB; a rule of n keywords has n entries of n.
NARROW = 100_000

#: One row per rule and keyword; the other columns repeat for the rule's keywords.
RULES_SCHEMA = (
    "rule long, template string, data_type string, shape string, label string, max_row long,"
    " keyword string, excluded boolean"
)


def rules_table(spark: SparkSession, templates: Iterable[Template]) -> DataFrame:
    """The SELF and NEAR rules of templates as a table."""
    rows = []
    rules = [(t, r) for t in templates for r in t.rules if r.shape in (SELF, NEAR)]
    for i, (t, r) in enumerate(rules):
        words = [(k, False) for k in r.keywords] + [(k, True) for k in r.exclude]
        rows += [(i, t.name, r.data_type, r.shape, r.label, r.max_row, k, out) for k, out in words]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def _runs(text: Column, length: Column) -> Column:
    """The distinct runs of so many characters of a text; none of a shorter one."""
    starts = F.when(F.length(text) >= length, F.sequence(F.lit(1), F.length(text) - length + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, length)))


def _index(words: DataFrame, gram: int) -> tuple[DataFrame, Column]:
    """(keyword, run) for all runs of keywords, and the runs of `value` of the lengths in use."""
    length = F.least(F.length("keyword"), F.lit(gram))
    used = sorted(r[0] for r in words.select(length.alias("n")).distinct().collect())  # `gram` at most
    none = F.array().cast("array<string>")
    own = [F.coalesce(_runs(F.col("value"), F.lit(n)), none) for n in used]
    return words.select("keyword", F.explode(_runs(F.col("keyword"), length)).alias("run")), F.flatten(F.array(none, *own))


def _rarest(index: DataFrame, often: DataFrame) -> DataFrame:
    """(keyword, run): of each keyword's runs one with the least n in `often`; none without any."""
    least = F.min(F.struct("n", "run")).alias("x")
    return index.join(often, "run").groupBy("keyword").agg(least).select("keyword", F.col("x.run").alias("run"))


def match_values(values: DataFrame, keywords: DataFrame, gram: int = GRAM) -> DataFrame:
    """(value, keyword): each distinct value with each keyword it contains, compared as is.

    `values` has a column value, `keywords` a column keyword. Null and empty keywords match
    nothing. Every value gives its runs of `gram` characters, and shorter ones only of lengths
    that some keyword has.
    """
    index, own = _index(keywords.where("keyword <> ''").select("keyword").distinct(), gram)
    held = values.where("value <> ''").select("value").distinct().select("value", F.explode(own).alias("run"))
    held = held.join(index.select("run").distinct(), "run", "left_semi")
    often = held.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return held.join(_rarest(index, often), "run").where(F.col("value").contains(F.col("keyword"))).select("value", "keyword")


def extract_by_table(grid: DataFrame, rules: DataFrame, gram: int = GRAM, narrow: int = NARROW) -> DataFrame:
    """Records of SELF and NEAR rules given as a table (`RULES_SCHEMA`), as `extract` gives them.

    Keywords are compared in upper case; a cell answers to a rule once, however many of its
    keywords it holds, and not if it holds an excluded one. A rule without keywords, or with
    excluded ones only, finds nothing. Rules of other shapes are an error.

    In a grid that carries each row's `template`, a rule sees the rows of its own template only.
    A sheet has one record per row, as the data model says.
    """
    wrong = [r[0] for r in rules.where(~F.col("shape").isin(SELF, NEAR)).select("shape").distinct().head(3)]
    if wrong:
        raise ValueError(f"only {SELF} and {NEAR} rules can be a table, not {wrong}")
    owned = "template" in grid.columns
    cell = F.col("_cell")
    first = F.greatest(F.col("_pos") + 1 - REACH, F.lit(1))
    cells = (
        pin_cells(grid.withColumnRenamed("template", "_owner"))
        .select(*SHEET_KEYS, *(["_owner"] if owned else []), "row", "cells", F.posexplode("cells").alias("_pos", "_cell"))
        .where(cell["cell_type"] == STRING)
        .withColumn("value", computed_once(F.upper(cell["value"])))
    )
    words = rules.select("rule", F.upper("keyword").alias("keyword"), "excluded").where("keyword <> ''")
    constants = rules.where("NOT excluded").groupBy("rule").agg(
        *[F.first(c).alias(f"_{c}") for c in ("template", "data_type", "shape", "label", "max_row")]
    )
    reach = F.slice("cells", first, F.col("_pos") + 2 + REACH - first).alias("_reach")
    kept = [*SHEET_KEYS, *(["_owner"] if owned else []), "row", cell["col"].alias("col"), "_cell", reach]
    size = F.count_if(~F.col("excluded")) * F.count(F.lit(1))
    if (words.groupBy("rule").agg(size.alias("n")).agg(F.sum("n")).first()[0] or 0) <= narrow:
        of_rule = words.groupBy("rule").agg(
            F.array_sort(F.collect_set(F.when(~F.col("excluded"), F.col("keyword")))).alias("_yes"),
            F.collect_set(F.when(F.col("excluded"), F.col("keyword"))).alias("_no"),
        )
        index, own = _index(words.where("NOT excluded").select("keyword").distinct(), gram)
        often = index.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
        entries = (
            _rarest(index, often)
            .join(of_rule.join(constants, "rule").withColumn("keyword", F.explode("_yes")), "keyword")
            .drop("rule")
        )
        # Of the keywords that a cell holds, the first one stands for the rule.
        held = lambda k: F.col("value").contains(k)
        hits = (
            cells.select(*kept, "value")  # before the runs, so that no row's cells are copied per run
            .withColumn("run", F.explode(own))
            .join(F.broadcast(entries), "run")
            .where(held(F.col("keyword")))
            .where((F.get(F.filter("_yes", held), F.lit(0)) == F.col("keyword")) & ~F.exists("_no", held))
            .drop("run", "keyword", "_yes", "_no")
        )
    else:
        matched = (
            match_values(cells.select("value"), words, gram)
            .join(words, "keyword")
            .groupBy("value", "rule")
            .agg(F.bool_or("excluded").alias("_out"))
            .where("NOT _out")
        )
        hits = cells.select(*kept, "value").join(matched.join(constants, "rule"), "value")
    seen = F.col("_max_row").isNull() | (F.col("row") < F.col("_max_row"))
    if owned:
        seen = seen & (F.col("_owner") == F.col("_template"))
    return _self_and_near(
        hits.where(seen)
        .withColumn("label", F.coalesce("_label", cell["value"]))
        .withColumnsRenamed({"_template": "template", "_data_type": "data_type"})
    )
