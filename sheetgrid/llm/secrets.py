"""Secret scans: candidates by form, false positives removed by a random forest.

A candidate is a run of 16 or more characters of a key's alphabet inside a word. Its features:

* length, and shares of digits, capitals and hexadecimal characters;
* character transitions: how often neighbours change class (letter, capital, digit, sign), the
  entropy of its characters, and its mean log probability under bigrams of the corpus;
* dictionary coverage: the share of it that pieces of a public vocabulary cover;
* path: whether it is a path of words or part of a URL, or a password in one, and whether the document's path names tests, samples or
  documentation;
* neighbouring words: an assignment before it, a key's name or a placeholder's near it, quotes.

The forest (Spark ML) is trained on labelled findings (at most `bound`). Where no labelled
findings are given, narrow rules label some candidates: a published key prefix, a value assigned
to a key's name in quotes or as name=value, or a password in a URL is a secret; runs of digits
alone, of one letter case alone, and parts of paths and URLs are none; all else stays unlabelled
and is judged by the forest. Values under 16 characters or with other signs are no candidates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgrid.llm import rolling, toxicity
from sheetgrid.llm.common import boxed, plain, stored

BOUND = 20_000
LEAST = 16
#: Bytes of a neighbouring word that describe a candidate: those nearest to it.
NEAR = 256
MASK = "[SECRET]"
TREES, DEPTH = 24, 6

# "=" belongs to a value as its padding only; name=value is cut there.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=\"'`$-]))?")
_KEY_NAME = re.compile(r"token|secret|passw|pwd|api_?-?key|apikey|access_?-?key|credential|auth|bearer|private", re.I)
_PLACEHOLDER = re.compile(
    r"(?<![a-z])(?:(?:examples?|samples?|dummy|placeholder|changeme|tests?|fake|redacted)(?![a-z])|your[_-])|xxxx", re.I
)
_PREFIX = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{30,}|sk_live_|xox[abp]-|glpat-|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{10,}")
_LOW_PATH = re.compile(r"test|sample|example|doc|fixture|mock", re.I)
_PIECE = re.compile(r"(?:[A-Za-z][a-z]*|[A-Z]+|v?\d{1,4})(?:[_-](?:[A-Za-z][a-z]*|[A-Z]+|v?\d{1,4}))*")
_URL_USER = re.compile(r"://[^/@:]*:$")
_LETTERS = re.compile(r"[A-Za-z]{4,}")

FEATURES = (
    "length", "digits", "capitals", "hex", "changes", "entropy", "bigrams", "coverage",
    "in_path", "low_path", "assigned", "key_name", "placeholder", "quoted", "prefix",
    "env", "url_password",
)


@cache
def vocabulary(path: str) -> frozenset[str]:
    """Words of four letters or more in a public tokenizer's vocabulary (its bounded size bounds this)."""
    from tokenizers import Tokenizer

    words = (piece.replace("Ġ", "").lower() for piece in Tokenizer.from_file(path).get_vocab())
    return frozenset(w for w in words if len(w) >= 4 and w.isalpha())


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of characters inside vocabulary words, longest first from the left."""
    done = 0
    for part in _LETTERS.findall(value):
        part, at = part.lower(), 0
        while at < len(part) - 3:
            size = next((n for n in range(min(12, len(part) - at), 3, -1) if part[at : at + n] in words), 0)
            done += size
            at += size or 1
    return done / len(value)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def describe(value: str, word: str, at: int, before: list[str], after: list[str], path: str, model, words) -> list[float]:
    """FEATURES of a candidate `value`, which begins at `at` in `word`."""
    n = len(value)
    kinds = [_kind(c) for c in value]
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    low = [toxicity.char_class(c) for c in value.lower()]
    left = " ".join([*before, word[:at]])
    close = left[-40:]
    near = " ".join([*before, word, *after])
    assigned = re.search(r"[=:]>?\s*[\"'`]?$", left) is not None
    key_name = bool(_KEY_NAME.search(close))
    covered = coverage(value, words)
    url_password = bool(_URL_USER.search(word[:at])) and word[at + n : at + n + 1] == "@"
    pieces = [x for x in value.split("/") if x]
    in_path = len(pieces) > 1 and (covered >= 0.6 or all(_PIECE.fullmatch(x) for x in pieces))
    in_url = ("://" in word or "@" in word) and not url_password and not (assigned and key_name)
    return [
        float(n),
        kinds.count(2) / n,
        kinds.count(1) / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(model[a, b] for a, b in zip(low, low[1:])) / n,
        covered,
        float(in_path or in_url),
        float(bool(_LOW_PATH.search(path))),
        float(assigned),
        float(key_name),
        float(bool(_PLACEHOLDER.search(near))),
        float(left[-1:] in ("'", '"', "`")),
        float(bool(_PREFIX.match(value))),
        float(word[at - 1 : at] == "="),
        float(url_password),
    ]


def rule_label(value: str, x: list[float]) -> int | None:
    """1 or 0 where a narrow rule is sure, else None."""
    f = dict(zip(FEATURES, x))
    if _PLACEHOLDER.search(value):
        return 0
    if f["prefix"]:
        return 1
    if f["placeholder"]:
        return 0
    mixed = f["entropy"] >= 3.0 and 0 < f["digits"] < 1 and not f["in_path"]
    if mixed and (f["url_password"] or (f["assigned"] and f["key_name"] and (f["quoted"] or f["env"]))):
        return 1
    if f["in_path"] or value.isdigit() or (value.isalpha() and (value.islower() or value.isupper() or value.istitle())):
        return 0
    return None


def _scan(batches: Iterator[pa.RecordBatch], model: np.ndarray, vocabulary_path: str) -> Iterator[pa.RecordBatch]:
    words = vocabulary(vocabulary_path)
    for batch in batches:
        ids, paths = batch.column("doc_id"), batch.column("path").to_pylist()
        for c in rolling.chunks(batch.column("text")):
            rows: dict[str, list] = {n: [] for n in ("row", "begin", "end", "value", "label", "x")}
            long = np.flatnonzero(c.ends - c.starts >= LEAST)
            inner = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])  # code points before a byte
            texts = c.row_of_word()[long] if len(long) else long
            for i, row in zip(long.tolist(), texts.tolist()):
                word = c.data[c.starts[i] : c.ends[i]].tobytes()
                text = None
                for m in _RUN.finditer(word.decode("latin-1")):  # byte positions; runs are ASCII
                    if text is None:
                        first, last = c.bounds[row], c.bounds[row + 1]
                        # Of very long neighbours, what lies nearest.
                        before, after = (
                            [c.data[c.starts[k] : c.ends[k]][part].tobytes().decode("utf-8", "ignore") for k in some]
                            for some, part in (
                                (range(max(first, i - 3), i), slice(-NEAR, None)),
                                (range(i + 1, min(last, i + 3)), slice(0, NEAR)),
                            )
                        )
                        text = word.decode("latin-1")
                    value = m.group()
                    x = describe(value, text, m.start(), before, after, paths[c.first + row] or "", model, words)
                    begin = int(c.starts[i]) + m.start()
                    zero = inner[c.offsets[row]]
                    rows["row"].append(c.first + row)
                    rows["begin"].append(int(inner[begin] - zero))
                    rows["end"].append(int(inner[begin + len(value)] - zero))
                    rows["value"].append(value)
                    rows["label"].append(rule_label(value, x))
                    rows["x"].append(x)
            where = pa.array(rows["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(where),
                    batch.column("text_hash").take(where),
                    pa.array(rows["begin"], pa.int64()),
                    pa.array(rows["end"], pa.int64()),
                    pa.array(rows["value"], pa.string()),
                    pa.array(rows["label"], pa.int32()),
                    pa.array(rows["x"], pa.list_(pa.float64())),
                ],
                ["doc_id", "text_hash", "begin", "end", "value", "label", "x"],
            )


def candidates(documents: DataFrame, vocabulary_path: str, path: str | None = None) -> DataFrame:
    """(doc_id, text_hash, begin, end, value, label, x): every candidate of every text. Positions are code
    points; `path` names the column with a document's path."""
    model = toxicity.language_model(documents)
    names = ["doc_id", "text", *([path] if path else [])]
    source = plain(documents, *names).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.xxhash64("text").alias("text_hash"),
        (F.col(f"`{path}`").cast("string") if path else F.lit("")).alias("path"),
    )
    return source.mapInArrow(
        lambda b: _scan(b, model, vocabulary_path),
        "doc_id long, text_hash long, begin long, end long, value string, label int, x array<double>",
    )


def train(labelled: DataFrame, bound: int = BOUND, seed: int = 6):
    """A random forest from labelled findings (label 0 or 1, x): at most half of `bound` of either
    label, the first by a hash of value and features. None without both labels."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    # Equal findings are one, so that copies of a document do not outweigh the rest.
    distinct = stored(labelled.where("label IN (0, 1)").groupBy("value", "x").agg(F.max("label").alias("label")))
    order = [F.xxhash64("value", "x"), F.col("value")]
    halves = [distinct.where(F.col("label") == k).orderBy(*order).limit(bound // 2) for k in (0, 1)]
    sample = stored(halves[0].unionByName(halves[1]).repartition(1).sortWithinPartitions("label", *order))
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=2
    )
    return forest.fit(sample.select(F.col("label").cast("double"), array_to_vector("x").alias("features")))


def scan(
    documents: DataFrame, vocabulary_path: str, path: str | None = None, labelled: DataFrame | None = None, bound: int = BOUND
) -> DataFrame:
    """Per candidate: doc_id, begin, end (code points), value_sha256, probability, is_secret,
    text_hash.

    `labelled`: findings with value, label and x, as `candidates` gives; else the rules label.
    Null and empty texts have no candidates. Without findings of both labels the narrow rules
    alone decide (unlabelled: no secret). Rows are scanned one by one, whatever their
    doc_id; other columns are ignored.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    found = stored(candidates(documents, vocabulary_path, path))
    forest = train(found if labelled is None else labelled, bound)
    if forest is None:
        judged = found.withColumn("probability", F.coalesce(F.col("label").cast("double"), F.lit(0.0)))
    else:
        judged = forest.transform(found.withColumn("features", array_to_vector("x"))).withColumn(
            "probability", vector_to_array("probability")[1]
        )
    return judged.select(
        "doc_id",
        "begin",
        "end",
        F.sha2("value", 256).alias("value_sha256"),
        F.round("probability", 6).alias("probability"),
        (F.col("probability") >= 0.5).alias("is_secret"),
        "text_hash",
    )


def redact(documents: DataFrame, findings: DataFrame, mask: str = MASK, length: str | None = None) -> DataFrame:
    """The documents with each secret replaced by `mask`; all rows and columns stay.

    Findings belong to a text, whatever its doc_id: a secret in one of several equal texts is masked
    in all. `length` names a column with the text's length, set anew where the text changes.
    """
    spans = (
        findings.where("is_secret")
        .groupBy("text_hash")
        .agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    )
    rows = boxed(documents, _hash=F.xxhash64(documents["`text`"]))
    text = F.col("doc")["text"]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(
        "spans",
        start,
        lambda a, s: F.struct(
            s["end"].alias("at"),
            F.concat(
                a["out"],
                F.substr(text, (a["at"] + 1).cast("int"), (s["begin"] - a["at"]).cast("int")),
                F.lit(mask),
            ).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))),
    )
    new = F.col("doc").withField("text", masked)
    if length:
        kind = documents.schema[length].dataType
        new = new.withField(f"`{length}`", F.length(masked).cast(kind))
    return (
        rows.join(spans, F.col("_hash") == F.col("text_hash"), "left")
        .select(F.when(F.col("spans").isNull(), F.col("doc")).otherwise(new).alias("doc"))
        .select("doc.*")
    )
