"""Mixing sources to target weights by subset-sum budget fitting.

* Every source gets a target of words; a source taken more than once is taken whole as often as
  fits, and the rest of its target is a budget to fill with some of its documents.
* Documents are counted by (source, exact length). From each length the budget's share is
  taken, and a bounded-knapsack dynamic program over the counts still free fills what is
  left, to the word where the lengths allow.
* Which documents of a length are taken is seeded: ranks by a hash of the row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetgrid.llm.common import boxed, plain, running, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20
#: Words of budget left to the dynamic program.
EXACT_WORDS = 20_000


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add `target` to (source, source_size), one row per source.

    Weights go round by code point of the source, null last. `share` of all words is
    divided by weight; no target exceeds `most` times its source, and the excess is
    shared by weight among the others until none is above. That is target = min(most *
    source_size, rate * weight) with one rate, found by going through the sources in the order
    in which a rising rate fills them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    rise = Window.orderBy("_full", "_nth")
    last = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    given = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sources.withColumn("_nth", F.row_number().over(by_name) - 1)
        .withColumn("_weight", F.element_at(given, (F.col("_nth") % len(weights) + 1).cast("int")))
        .withColumn("_most", F.col("source_size") * F.lit(float(most)))
        .withColumn("_full", F.col("_most") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(last) * F.lit(float(share)))
        .withColumn("_spent", F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(last) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        # The rate if all sources before this one are full and the rest is shared.
        .withColumn("_rate", (F.col("_budget") - F.col("_spent")) / F.col("_open"))
        .withColumn("_open_from", F.when(F.col("_rate") < F.col("_full"), F.struct(F.row_number().over(rise), F.col("_rate").alias("rate"))))
        .withColumn("_rate", F.min("_open_from").over(last)["rate"])
        .withColumn("target", F.when(F.col("_rate").isNull(), F.col("_most")).otherwise(F.least("_most", F.col("_rate") * F.col("_weight"))))
        .drop("_nth", "_weight", "_most", "_full", "_budget", "_spent", "_open", "_rate", "_open_from")
    )


def fit_budget(counts: dict[int, int], budget: int, exact: int = EXACT_WORDS) -> dict[int, int]:
    """How many documents of each length to take so that their words come nearest to `budget`.

    counts: documents by length. Takes each length's share of the budget, then the longest
    that fit, until `exact` words are left; a bounded knapsack over reachable sums does the rest.
    """
    lengths = sorted((n for n in counts if n > 0), reverse=True)
    total = sum(n * counts[n] for n in lengths)
    budget = max(0, min(budget, total))
    if not budget:
        return {}
    take = {n: counts[n] * budget // total for n in lengths}
    left = budget - sum(n * k for n, k in take.items())
    for n in lengths:
        more = min(counts[n] - take[n], max(0, left - exact // 2) // n)
        take[n] += more
        left -= n * more
    # Reachable sums as bits; a bundle of k equal documents is one item (1, 2, 4, ... and the rest).
    longest = max((n for n in lengths if counts[n] > take[n]), default=0)
    limit = left + min(left, longest) + 1
    mask = (1 << limit) - 1
    reach, items = [1], []
    for n in lengths:
        free, bundle = min(counts[n] - take[n], limit // n), 1
        while free > 0:
            k = min(bundle, free)
            new = (reach[-1] | reach[-1] << n * k) & mask
            if new != reach[-1]:
                items.append((n, k))
                reach.append(new)
            free, bundle = free - k, bundle * 2
    gap = 0
    while not ((left >= gap and reach[-1] >> (left - gap) & 1) or reach[-1] >> (left + gap) & 1):
        gap += 1
    at = left - gap if left >= gap and reach[-1] >> (left - gap) & 1 else left + gap
    for (n, k), before in zip(reversed(items), reversed(reach[:-1])):
        if not before >> at & 1:
            take[n] += k
            at -= n * k
    return {n: k for n, k in take.items() if k}


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source's histogram: base copies of all, and how many of each length once more."""
    target, size = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
    base = int(min(target // size, MOST)) if size else 0
    take = fit_budget(dict(zip(rows["size"].tolist(), rows["n"].tolist())), round(target) - base * size)
    rows["base"] = base
    rows["more"] = [take.get(n, 0) for n in rows["size"].tolist()]
    return rows[["source", "size", "source_size", "target", "base", "more"]]


def mix(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken, source, text_hash.

    taken = size times 0, 1 or 2. Null and empty texts have size 0. Null doc_ids and rows that
    repeat a doc_id are documents of their own; a null source is a source. Reruns agree: the
    choice depends on the rows and the seed alone. Any other column is ignored.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sizes = stored(
        plain(documents, "doc_id", "source", "text").select(
            F.col("doc_id").cast("long").alias("doc_id"), "source", words.alias("size"), F.xxhash64("text").alias("text_hash")
        )
    )
    counts = stored(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = counts.groupBy("source").agg(F.sum(F.expr("n * size")).alias("source_size"), F.sum("n").alias("docs"))
    aims = stored(targets(per_source))
    rows = aims.agg(F.sum("docs")).first()[0] or 0
    same = F.col("source").eqNullSafe(F.col("_source"))
    plan = stored(
        counts.join(aims.withColumnRenamed("source", "_source").drop("docs"), same)
        .drop("_source")
        .groupBy("source")
        .applyInPandas(_fit, "source string, size long, source_size long, target double, base int, more long")
    )
    pick = F.xxhash64("doc_id", "text_hash", F.lit(seed))
    order = [pick, F.col("doc_id"), F.col("text_hash")]
    placed = running(sizes, ["source", "size"], F.lit(1), order, pick, rows, "rank")
    known = plan.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target", "base", "more")
    return placed.join(known, same & (F.col("size") == F.col("_size"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("base") + F.when(F.col("rank") < F.col("more"), 1).otherwise(0))).cast("long").alias("taken"),
        "source",
        "text_hash",
    )


def mixed(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents as often as `mix` takes them; all columns stay.

    Rows equal in doc_id, source and text are taken together. Texts without words are not taken.
    """
    copies = (
        chosen.where("taken > 0")
        .groupBy("doc_id", "source", "text_hash")
        .agg(F.sum(F.expr("taken div size")).cast("int").alias("copies"))
    )
    rows = boxed(
        documents,
        _id=documents["`doc_id`"].cast("long"),
        _source=documents["`source`"],
        _hash=F.xxhash64(documents["`text`"]),
    ).dropDuplicates(["_id", "_source", "_hash"])
    same = (
        F.col("_id").eqNullSafe(F.col("doc_id"))
        & F.col("_source").eqNullSafe(F.col("source"))
        & (F.col("_hash") == F.col("text_hash"))
    )
    return (
        rows.join(copies, same)
        .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc.*")
    )
