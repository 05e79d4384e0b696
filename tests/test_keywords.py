"""Rules as a table against the rules written into the plan, and against `in`."""

import random

import pytest

from sheetgrid.operators.extract import RECORD, extract
from sheetgrid.operators.keywords import NARROW, RULES_SCHEMA, extract_by_table, match_values, rules_table
from sheetgrid.plans.rules import BELOW, BUILT_IN, NEAR, SELF, Rule, Template


def rows(df):
    return sorted((tuple(r) for r in df.select(*RECORD).collect()), key=repr)


def words(rng, n, longest=9):
    return ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, longest))) for _ in range(n)]


def test_match_values_is_contains(spark):
    rng = random.Random(3)
    values = words(rng, 400, 30) + ["", None, "aaaa" * 5000 + "bca", "aaaa", "aaaa"]
    keywords = words(rng, 300) + ["", None, "a", "aaaa", "aaaab", "aaaab", "zz"]
    left = spark.createDataFrame([(v,) for v in values], "value string").repartition(3)
    right = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    want = sorted((v, k) for v in set(values) if v for k in set(keywords) if k and k in v)
    for gram in (1, 3, 4):
        assert sorted(tuple(r) for r in match_values(left, right, gram).collect()) == want
    assert match_values(left.where("false"), right).collect() == []
    assert match_values(left, right.where("keyword = ''")).collect() == []


def test_table_equals_plan(spark, grid):
    rng = random.Random(5)
    sheets = {}
    for f in range(4):
        for s in range(2):
            sheets[f"f{f}", f"s{s}"] = {
                r: [rng.choice([None, 7, True, " ", *words(rng, 6), "Fecha: x", "FOLIO 3"]) for _ in range(rng.randrange(1, 9))]
                for r in range(25)
            }
    cells = grid(sheets)
    template = Template(
        "t",
        rules=tuple(
            Rule(f"d{i}", rng.choice([SELF, NEAR]), tuple(words(rng, 2, 4)), rng.choice([None, 10]), rng.choice([None, "l"]), tuple(words(rng, rng.choice([0, 2]), 4)))
            for i in range(40)
        ),
    )
    templates = [template, *[Template(t.name, rules=tuple(r for r in t.rules if r.shape in (SELF, NEAR))) for t in BUILT_IN if t.rules]]
    assert len(rows(extract(cells, templates).records)) > 500
    owned = cells.selectExpr("*", "if(source_file < 'f2', 't', 'sdm') AS template")
    for narrow in (NARROW, 0):
        assert rows(extract_by_table(cells, rules_table(spark, templates), narrow=narrow)) == rows(extract(cells, templates).records)
        assert rows(extract_by_table(owned, rules_table(spark, templates), narrow=narrow)) == rows(extract(owned, templates).records)


def test_plan_does_not_grow_with_rules(spark, grid):
    cells = grid({("f", "s"): {0: ["alpha", 1, "beta"], 1: ["gamma alpha"]}})

    def planned(n):
        rules = spark.range(n).selectExpr(
            "id AS rule", "'t' AS template", "'d' AS data_type", "'self' AS shape", "string(null) AS label",
            "bigint(null) AS max_row", "if(id = 0, 'ALPHA', 'word' || id) AS keyword", "false AS excluded",
        )
        found = extract_by_table(cells, rules)
        return len(found._jdf.queryExecution().optimizedPlan().toString()), found.count()

    (short, few), (long, many) = planned(3), planned(5000)
    assert few == many == 2 and abs(long - short) < 50


def test_awkward_rules(spark, grid):
    cells = grid({("f", "s"): {0: ["alpha", None, "beta"]}})
    made = lambda *rows: spark.createDataFrame(rows, RULES_SCHEMA)
    assert rows(extract_by_table(cells, made())) == []
    none = made((1, "t", "d", SELF, None, None, None, False), (2, "t", "d", SELF, None, None, "", False), (3, "t", "d", SELF, None, None, "ALP", True))
    assert rows(extract_by_table(cells, none)) == []
    twice = made(*[(1, "t", "d", SELF, None, None, "alp", False)] * 2, (1, "t", "d", SELF, None, None, "PHA", False))
    assert [r[5] for r in rows(extract_by_table(cells, twice))] == ["alpha"]
    with pytest.raises(ValueError, match="below"):
        extract_by_table(cells, made((1, "t", "d", BELOW, None, None, "a", False)))
