"""Source divergence audit: how far the vocabulary of each source lies from the others' of its language.

Terms are counted without hashing: per shard of texts, pointers to term starts are sorted over the
Arrow buffer (`pointers.sort`), and a run of equal terms gives its document frequency and its
count per source. Texts are put in order of (lang, source) first, so that a run's pointers
come source by source. Counts of shards merge map-side and meet by (lang, source, term).

Shares are whole numbers of a thousand-millionth: 1 + floor(10^9 * (count + 5) / (N + 5 V)), computed in
decimals, so that no size of corpus overflows them.

Sums over all kept terms of |p - q| for each two sources are formed per block of terms from a
matrix (terms by sources), so no pair of sources is formed per term. Sources are dealt into tiles,
which bounds the matrix whatever the number of sources; what a term adds where neither source
has it depends on the pair alone and is added once for all terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetgrid.llm import pointers
from sheetgrid.llm.common import forget, plain, stored

LEAST_DOCUMENTS = 30
TOP = 50
#: Added to every count; the whole that shares are parts of.
PRIOR, WHOLE = 5, 1_000_000_000
#: Terms of a block, about; sources of a tile.
BLOCK_TERMS, TILE = 1024, 256

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[ord("A") : ord("Z") + 1] = _INSIDE[ord("a") : ord("z") + 1] = _INSIDE[0x80:] = True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of each shard."""
    for batch in batches:
        lang = batch.column("lang").fill_null("").dictionary_encode()
        source = batch.column("source").fill_null("").dictionary_encode()
        n_sources = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
        by = np.argsort(group, kind="stable")
        texts, group = batch.column("text").take(pa.array(by)), group[by]
        for first, last, data, offsets in pointers.shards(texts):
            starts, ends, rows = pointers.slices(_INSIDE[data], offsets)
            if not len(starts):
                continue
            words = pointers.Words(data, starts, ends)
            order, new = pointers.sort(words)
            row = rows[order]
            own = group[first:last][row]
            cut = new.copy()
            cut[1:] |= own[1:] != own[:-1]
            document = cut.copy()
            document[1:] |= row[1:] != row[:-1]
            at = np.flatnonzero(cut)
            key = own[at]
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(key // n_sources)),
                    source.dictionary.take(pa.array(key % n_sources)),
                    words.strings(order[at]),
                    pa.array(np.diff(np.append(at, len(order)))),
                    pa.array(np.add.reduceat(document.astype(np.int64), at)),
                ],
                ["lang", "source", "term", "n", "df"],
            )


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term in each group."""
    source = plain(documents, "lang", "source", "text")
    counted = source.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 terms)) in decimals, from column names."""
    up = f"(CAST({count} AS DECIMAL(20,0)) + {PRIOR}BD) * {WHOLE}BD"
    down = f"(CAST({total} AS DECIMAL(20,0)) + CAST({terms} AS DECIMAL(20,0)) * {PRIOR}BD)"
    return F.expr(f"IF({terms} > 0, 1 + {up} div {down}, 0)")


def _apart(rows: pd.DataFrame, tile: int) -> pd.DataFrame:
    """What a block of terms adds to the distance of each two sources of two tiles.

    Rows without a term name the sources: each has its `idx` and, as p, its share of a term
    that it does not have.
    """
    lang, a, b, block = rows[["lang", "a", "b", "block"]].iloc[0]
    named = rows["term"].isna()
    sources = rows[named].sort_values("idx", ignore_index=True)
    base = sources["p"].to_numpy()
    place = pd.Series(np.arange(len(sources)), index=sources["idx"].to_numpy())
    cells = rows[~named]
    term, distinct = pd.factorize(cells["term"])
    shares = np.tile(base, (len(distinct), 1))
    shares[term, place[cells["idx"]].to_numpy()] = cells["p"].to_numpy()
    tiles = sources["idx"].to_numpy() // tile
    # Of all terms, those of no block lie `base` apart, too: counted once, by block 0.
    elsewhere = (int(sources["terms"].iloc[0]) if block == 0 else 0) - len(distinct)
    right = np.flatnonzero(tiles == b)
    out = []
    for i in np.flatnonzero(tiles == a):
        others = right[right > i]
        apart = np.abs(shares[:, others] - shares[:, [i]]).sum(axis=0)
        apart += elsewhere * np.abs(base[others] - base[i])
        out.append(pd.DataFrame({"source": sources["source"][i], "item": sources["source"][others], "value": apart}))
    found = pd.concat(out, ignore_index=True)
    found.insert(0, "lang", lang)
    return found


def _distances(cells: DataFrame, sources: DataFrame, tile: int, block_terms: int) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language, source before item."""
    tiles = (
        sources.withColumn("tile", F.expr(f"idx div {tile}"))
        .withColumn("other", F.explode(F.expr(f"sequence(0L, (n_sources - 1) div {tile})")))
        .withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
    )
    names = tiles.withColumn("block", F.explode(F.expr(f"sequence(0L, (terms - 1) div {block_terms})"))).select(
        "lang", "a", "b", "block", "source", "idx", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), "terms"
    )
    spread = (
        cells.withColumn("tile", F.expr(f"idx div {tile}"))
        .withColumn("other", F.explode(F.expr(f"sequence(0L, (n_sources - 1) div {tile})")))
        .select(
            "lang",
            F.least("tile", "other").alias("a"),
            F.greatest("tile", "other").alias("b"),
            F.pmod(F.xxhash64("term"), F.expr(f"1 + (terms - 1) div {block_terms}")).alias("block"),
            "source",
            "idx",
            "term",
            "p",
            "terms",
        )
    )
    parts = names.unionByName(spread).groupBy("lang", "a", "b", "block")
    found = parts.applyInPandas(lambda rows: _apart(rows, tile), "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, tile: int = TILE, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """Per (lang, source) group: lang, source, part, item, value, rank.

    Part `pair`: every other source of the language, value the sum of |p - q| over all kept terms
    (0 without any). Part `term`: the `top` terms that the group has and uses more than its language
    does. A language keeps the terms found in at least `least` of its documents. Ranks
    go by falling value, then by item.

    Null lang, source and text count as ''. A group of empty texts has no terms; its pairs are there.
    Repeated rows are documents of their own; doc_id and other columns play no part. A
    language with one source has no pairs, an empty table gives no rows.
    """
    counts = stored(term_counts(documents))
    terms = stored(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df")
    )
    kept = stored(counts.join(terms, ["lang", "term"]))
    by_name = Window.partitionBy("lang").orderBy("source")
    named = plain(documents, "lang", "source").na.fill("").distinct()
    sources = stored(
        named.join(terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .na.fill(0)
        .withColumn("idx", F.row_number().over(by_name).cast("long") - 1)
        .withColumn("n_sources", F.count("*").over(Window.partitionBy("lang")))
        .withColumn("base", _share("0", "total", "terms"))
    )
    cells = stored(
        kept.join(sources, ["lang", "source"])
        .withColumns({"p": _share("n", "total", "terms"), "q": _share("lang_n", "lang_total", "terms")})
        .select("lang", "source", "idx", "n_sources", "terms", "term", "p", "q")
    )
    pairs = stored(_distances(cells, sources, tile, block_terms))
    for table in (counts, terms, kept):
        forget(table)
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    more = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [
        both.withColumn("rank", rank).withColumn("part", F.lit("pair")),
        more.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")),
    ]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")
