"""Secret scans: positions, features, and held-out accuracy of the forest on planted findings."""

import random
import re

import public_tokenizers
import pytest

from sheetgrid.llm import secrets
from tests.llm.conftest import rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def planted(seed, n=300):
    """(doc_id, text, value or None): half with a key, half with something that only looks long."""
    rng = random.Random(seed)
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "the quick brown fox jumps over a lazy dog while rain falls on the plain".split()
    out = []
    for i in range(n):
        before = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))
        if i % 2:
            value = "".join(rng.choice(rng.choice([hexes, mixed])) for _ in range(rng.choice([24, 32, 40])))
            if value.isalpha() or value.isdigit():
                value += "a1"
            name = rng.choice(["token", "api_key", "password", "secret", "auth_token"])
            text = f'{before} é {name} = "{value}" {before}'
        else:
            value = None
            odd = rng.choice(
                [
                    "internationalization", "4" * 16 + str(rng.randrange(10**6)), "https://example.com/a/very/long/path/index",
                    "supercalifragilistic", "12345678-90123456-7890", "antidisestablishmentarianism", "docs/sample/configuration/file",
                ]
            )
            text = f"{before} é {odd} {before}"
        out.append((i, text, value))
    return out


def test_held_out_accuracy(spark):
    train, test = planted(1), planted(2)
    cells = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    labelled = secrets.candidates(cells, PATH)
    truth = spark.createDataFrame([(i, v) for i, _, v in train], "id long, secret string")
    labelled = labelled.join(truth, labelled["doc_id"] == truth["id"]).selectExpr("value", "x", "int(value <=> secret) AS label")
    df = spark.createDataFrame([(i, t) for i, t, _ in test], "doc_id long, text string")
    found = secrets.scan(df, PATH, labelled=labelled).collect()
    texts = {i: (t, v) for i, t, v in test}
    hits = {r["doc_id"]: texts[r["doc_id"]][0][r["begin"] : r["end"]] for r in found if r["is_secret"]}
    want = {i: v for i, _, v in test if v}
    assert sum(hits.get(i) == v for i, v in want.items()) >= 0.97 * len(want)
    assert len([i for i in hits if i not in want]) <= 0.02 * len(test)


def test_rules_label_where_nothing_is_given_and_redaction(spark):
    docs = planted(3)
    df = spark.createDataFrame([(i, t, len(t), "x") for i, t, _ in docs], "doc_id long, text string, n_chars long, spans string")
    df = df.selectExpr("*", "spans AS text_hash", "1 AS begin", "2 AS _hash", "3 AS doc")
    got = secrets.redact(df, secrets.scan(df, PATH), length="n_chars")
    assert got.columns == df.columns
    masked = {r["doc_id"]: r for r in got.collect()}
    for i, text, value in docs:
        want = text.replace(value, secrets.MASK) if value else text
        assert masked[i]["text"] == want and masked[i]["n_chars"] == len(want)


def test_features():
    model = __import__("numpy").full((secrets.toxicity.CLASSES,) * 2, -3.0)
    x = dict(zip(secrets.FEATURES, secrets.describe("ab12CD34ab12CD34", '"ab12CD34ab12CD34";', 1, ["my", "token", "="], ["and"], "test/x", model, frozenset())))
    assert x["length"] == 16 and x["digits"] == 0.5 and x["capitals"] == 0.25 and x["hex"] == 1.0
    assert x["assigned"] == x["key_name"] == x["quoted"] == x["low_path"] == 1.0 and x["in_path"] == x["prefix"] == 0.0
    assert x["changes"] == 7 / 16 and x["entropy"] == pytest.approx(3.0)
    assert secrets.coverage("thinghouse", frozenset(["thing", "house"])) == 1.0
    assert secrets.coverage("12thing345", frozenset(["thing"])) == 0.5


@pytest.mark.parametrize(
    "word, before, value, label",
    [
        ('"wJalrXUtnF/K7MDENG/bPxRfiCYz9pQ2LkTv4s"', ["secret_key", "="], "wJalrXUtnF/K7MDENG/bPxRfiCYz9pQ2LkTv4s", 1),
        ("API_KEY=ghp_a8Kd03LmQz71XvBn45TyUi92OpAs67DfGh10", [], "ghp_a8Kd03LmQz71XvBn45TyUi92OpAs67DfGh10", 1),
        ("AUTH_TOKEN=q8Kd03LmQz71XvBn45Ty==", [], "q8Kd03LmQz71XvBn45Ty==", 1),
        ("postgres://app:q8Kd03LmQz71XvBn45@db/main", [], "q8Kd03LmQz71XvBn45", 1),
        ('"q8Kd03LmQz71XvBn45Ty"', ["latest", "token", "="], "q8Kd03LmQz71XvBn45Ty", 1),
        ('"q8Kd03LmQz71XvBn45Ty"', ["example", "token", "="], "q8Kd03LmQz71XvBn45Ty", 0),
        ("docs/sample/configuration/file", [], "docs/sample/configuration/file", 0),
        ("https://x.org/a/very/long/path/index", [], "org/a/very/long/path/index", 0),
    ],
)
def test_rules_on_keys_with_slashes_env_files_and_urls(word, before, value, label):
    model = __import__("numpy").full((secrets.toxicity.CLASSES,) * 2, -3.0)
    at = {m.group(): m.start() for m in secrets._RUN.finditer(word)}
    assert value in at
    assert secrets.rule_label(value, secrets.describe(value, word, at[value], before, [], "", model, frozenset())) == label


def test_awkward_rows(spark, awkward, nothing):
    assert secrets.scan(awkward, PATH, path="source").collect() == []
    assert secrets.scan(nothing, PATH).collect() == []
    assert rows_of(secrets.redact(awkward, secrets.scan(awkward, PATH)), *awkward.columns) == rows_of(awkward, *awkward.columns)


def test_candidates_equal_a_plain_scan(spark):
    rng = random.Random(4)
    letters = "abcXYZ019+/=_-.,:\"' \n\té日"
    rows = [(i, "".join(rng.choice(letters if rng.random() < 0.5 else "aB3") for _ in range(rng.randrange(300)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "k" * 5000 + " " + "Q7" * 40)]
    got = secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    want = []
    for i, text in rows:
        for word in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
            for m in secrets._RUN.finditer(word.group()):
                begin = word.start() + m.start()
                want.append((i, begin, begin + len(m.group()), m.group()))
    assert rows_of(got, "doc_id", "begin", "end", "value") == sorted(want, key=repr)


@pytest.mark.parametrize("glue", ["", "w" * 10, "y" * 81, "z" * 3000])
def test_a_key_name_at_the_end_of_a_long_word(spark, glue):
    text = f'say {glue}"api_key": "q8KdZ0vP3mXt7RbY1cLw5HsN"'
    (row,) = secrets.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).where("value LIKE 'q8Kd%'").collect()
    x = dict(zip(secrets.FEATURES, row["x"]))
    assert (row["label"], x["key_name"], x["assigned"], x["quoted"]) == (1, 1, 1, 1)
