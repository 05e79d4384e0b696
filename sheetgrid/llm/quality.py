"""Quality rules: base limits, then robust multivariate outliers per language and source.

Built-in functions only. One pass over the texts gives the counts of each document; everything
after that works on short records.

* A document's vector: log of the mean word length, and square roots of symbols per word
  character, repeated lines per word and repeated words per word, in whole thousandths.
* Per (language, source), and once over all, the minimum covariance determinant is sought: of all
  halves of a group, the one whose covariance has the least determinant. From each of several
  starts, concentration steps take the half with the smallest Mahalanobis distances and estimate
  mean and covariance from it. After two steps a group's `KEEP` best starts go on until the
  determinant no longer falls; the one that ends with the least counts. Equal vectors are one weighted record. The half is found by counting distances
  in fixed bins, and sums are of whole numbers, so reruns agree whatever the partitions.
* A group of fewer than `LEAST` documents, five for each statistic, has no estimate of its own and takes
  the one over all. A larger group's is averaged with that over all, which counts as `PRIOR`
  documents. Each statistic has a least spread, in determinants too, since most documents have
  no symbol and no repeat at all.
* Rejected: a squared distance above `CUTOFF`. Fewer symbols or repeats than the group's
  centre is no fault: such a deviation counts as zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetgrid.llm.common import forget, plain, stored

SYMBOLS = "[#*$%&|<>]"
DIMS = ("z1", "z2", "z3", "z4")
#: Least standard deviation of each statistic, in thousandths.
FLOORS = (120, 50, 50, 100)
#: At most so many concentration steps; far fewer are needed.
STEPS = 20
PRIOR = 50
#: Documents that a group needs for an estimate of its own.
LEAST = 20
#: Starts at a vector picked by hash, beside the four others, and how many starts go on after two steps.
DRAWS = 12
KEEP = 3
#: Keys that a group is dealt over where its vectors meet its parameters.
PARTS = 16
#: Six standard deviations along one statistic; the 0.9999997 quantile of chi-square with four
#: degrees of freedom.
CUTOFF = 36.0
WINDOW_WORDS = 5
#: Scale of a consistent half-sample covariance of a normal distribution in four dimensions.
CONSISTENCY = 2.2


def let(value: Column, body) -> Column:
    """body(value), with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(words: Column) -> Column:
    """How many words lie in windows of five that occur twice or more."""
    size = F.size(words)
    last = size - WINDOW_WORDS

    def covered(spots: Column) -> Column:
        # Windows by hash and place; a window that equals a neighbour in that order is repeated.
        def repeated(order: Column) -> Column:
            same = lambda x, i, d: F.coalesce(F.get(order, i + d)["h"] == x["h"], F.lit(False))
            at = F.filter(order, lambda x, i: same(x, i, -1) | same(x, i, 1))
            return F.array_sort(F.transform(at, lambda x: x["i"]))

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            repeated_of(spots, repeated),
            zero,
            lambda a, i: F.struct(
                (i + WINDOW_WORDS).alias("end"),
                (a["n"] + i + WINDOW_WORDS - F.greatest(a["end"], i)).alias("n"),
            ),
            lambda a: a["n"],
        )

    def repeated_of(hashes: Column, pick) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(order, pick)

    def windows(own: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(WINDOW_WORDS)])
        )

    return F.when(size < WINDOW_WORDS + 1, 0).otherwise(
        let(
            let(F.transform(words, lambda w: F.xxhash64(w)), windows),
            lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes)),
        )
    )


def counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeats(w).cast("long").alias("n_repeat_words"),
        ),
    )


def _vector() -> list[Column]:
    words = F.col("n_words")
    values = [
        F.log(F.col("word_chars") / words),
        F.sqrt(F.col("n_symbols") / F.col("word_chars")),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    # Base failures, texts without words among them, have no vector.
    return [
        F.when(~F.col("base_failed"), F.round(v * 1000).cast("long")).alias(z) for z, v in zip(DIMS, values)
    ]


def _medians(cells: DataFrame) -> DataFrame:
    """(g, m1.., c11..): coordinate medians, and variances from the median absolute deviation."""

    def middle(values: DataFrame) -> DataFrame:
        # The weighted median per (g, dim), from counts of whole numbers.
        by = Window.partitionBy("g", "dim")
        run = values.groupBy("g", "dim", "v").agg(F.sum("w").alias("w")).withColumn(
            "upto", F.sum("w").over(by.orderBy("v"))
        ).withColumn("all", F.sum("w").over(by))
        return run.where("2 * upto >= all").groupBy("g", "dim").agg(F.min("v").alias("v"))

    long = cells.select(
        "g", "w", F.posexplode(F.array(*DIMS)).alias("dim", "v")
    )
    centre = stored(middle(long))
    spread = middle(
        long.join(centre.withColumnRenamed("v", "m"), ["g", "dim"]).select("g", "dim", "w", F.abs(F.col("v") - F.col("m")).alias("v"))
    )
    both = centre.withColumnRenamed("v", "m").join(spread, ["g", "dim"])
    pick = lambda i, x: F.max(F.when(F.col("dim") == i, x))
    n = range(len(DIMS))
    return both.groupBy("g").agg(
        *[pick(i, F.col("m").cast("double")).alias(f"m{i}") for i in n],
        *[
            (pick(i, F.pow(1.4826 * F.col("v"), 2)) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
            for i in n
            for j in range(i + 1)
        ],
    )


def _cholesky(params: DataFrame) -> DataFrame:
    """Add l00.. with L L' = covariance, each variance at least its floor's square more."""
    n = range(len(DIMS))
    for i in n:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (float(FLOORS[i] ** 2) if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}")
            params = params.withColumn(f"l{i}{j}", value)
    return params


def distance(one_sided: bool) -> Column:
    """Squared Mahalanobis distance of z1.. from m0.. under l00.. ."""
    solved: list[Column] = []
    for i, z in enumerate(DIMS):
        part = F.col(z) - F.col(f"m{i}")
        if one_sided and i:
            part = F.greatest(part, F.lit(0.0))
        for k in range(i):
            part = part - F.col(f"l{i}{k}") * solved[k]
        solved.append(part / F.col(f"l{i}{i}"))
    total = solved[0] * solved[0]
    for x in solved[1:]:
        total = total + x * x
    return total


def _sums(values: DataFrame, *keys: str) -> DataFrame:
    """Weight, sums and sums of products per key, exact."""
    n = range(len(DIMS))
    exact = lambda x: F.sum((x * F.col("w")).cast("decimal(28,0)"))
    return values.groupBy(*keys).agg(
        F.sum("w").alias("w"),
        *[exact(F.col(z)).alias(f"s{i}") for i, z in enumerate(DIMS)],
        *[exact(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q{i}{j}") for i in n for j in range(i + 1)],
    )


def _moments(sums: DataFrame, scale: float, *keys: str) -> DataFrame:
    """m0.. and c00.. (times `scale`) from the sums, beside the columns `keys`."""
    n = range(len(DIMS))
    mean = lambda i: F.col(f"s{i}").cast("double") / F.col("w")
    return sums.select(
        *keys,
        *[mean(i).alias(f"m{i}") for i in n],
        *[
            (scale * (F.col(f"q{i}{j}").cast("double") / F.col("w") - mean(i) * mean(j))).alias(f"c{i}{j}")
            for i in n
            for j in range(i + 1)
        ],
    )


def _met(cells: DataFrame, params: DataFrame) -> DataFrame:
    """Each vector with its group's parameters; a group is `PARTS` keys, so none is one task's."""
    return cells.join(params.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["g", "part"])


def _starts(cells: DataFrame) -> DataFrame:
    """(g, start, m0.., c00..): first estimates of each group.

    0: coordinate medians and median absolute deviations; 1: the medians, no spread but the least
    ones; 2: mean and covariance of all; 3: the medians, covariance of the directions from there,
    as large in sum as the variances of 0; 4 and up: a vector picked by hash, the deviations of 0.
    """
    n = range(len(DIMS))
    pairs = [(i, j) for i in n for j in range(i + 1)]
    medians = stored(_medians(cells))
    zeros = [F.lit(0.0).alias(f"c{i}{j}") for i, j in pairs]
    centre = [f"m{i}" for i in n]
    away = [F.col(z) - F.col(f"m{i}") for i, z in enumerate(DIMS)]
    length2 = sum((x * x for x in away[1:]), away[0] * away[0])
    turned = (
        _met(cells, medians)
        .groupBy("g")
        .agg(
            F.sum("w").alias("w"),
            *[
                F.sum((F.coalesce(F.try_divide(away[i] * away[j], length2), F.lit(0.0)) * 1_000_000 * F.col("w")).cast("decimal(28,0)")).alias(f"t{i}{j}")
                for i, j in pairs
            ],
        )
        .join(medians, "g")
    )
    size = sum((F.col(f"c{i}{i}") for i in n[1:]), F.col("c00"))
    first = lambda k: F.min(F.struct(F.xxhash64(*DIMS, F.lit(k)).alias("h"), *DIMS))
    picked = (
        cells.groupBy("g")
        .agg(F.array(*[first(k) for k in range(DRAWS)]).alias("picks"))
        .select("g", F.posexplode("picks").alias("k", "z"))
        .join(medians.drop(*centre), "g")
        .select(
            "g",
            (F.col("k") + 4).alias("start"),
            *[F.col(f"z.{z}").cast("double").alias(f"m{i}") for i, z in enumerate(DIMS)],
            *[f"c{i}{j}" for i, j in pairs],
        )
    )
    directions = [(F.col(f"t{i}{j}").cast("double") / 1_000_000 / F.col("w") * size).alias(f"c{i}{j}") for i, j in pairs]
    return (
        medians.select("g", F.lit(0).alias("start"), *centre, *[f"c{i}{j}" for i, j in pairs])
        .unionByName(medians.select("g", F.lit(1).alias("start"), *centre, *zeros))
        .unionByName(_moments(_sums(cells, "g").withColumn("start", F.lit(2)), 1.0, "g", "start"))
        .unionByName(turned.select("g", F.lit(3).alias("start"), *centre, *directions))
        .unionByName(picked)
    )


def _concentrate(cells: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step: mean, covariance, its factor and log determinant of each start's nearer
    half; `was` is the log determinant before.

    Sums are taken per (group, start, distance bin), so a hot group merges map-side; the bins up
    to the half are then added up, of the last one the share that makes the half exact.
    """
    by = Window.partitionBy("g", "start")
    met = _met(cells, params.withColumnRenamed("logdet", "was"))
    bins = (
        _sums(met.withColumn("bin", F.floor(64 * F.log1p(distance(False))).cast("long")), "g", "start", "was", "bin")
        .withColumn("before", F.sum("w").over(by.orderBy("bin")) - F.col("w"))
        .withColumn("all", F.sum("w").over(by))
        .withColumn("half", F.least("all", F.floor((F.col("all") + len(DIMS) + 1) / 2)))
        .where("before < half")
        .withColumn("share", F.least(F.lit(1.0), (F.col("half") - F.col("before")) / F.col("w")))
    )
    # Whole bins are summed as they are, and the last one's share is added, so the order of sums is fixed.
    names = ["w", *[c for c in bins.columns if c[0] in "sq" and c[1:].isdigit()]]
    inner = F.col("share") == 1.0
    near = bins.groupBy("g", "start", "was").agg(
        *[
            (
                F.coalesce(F.sum(F.when(inner, F.col(c))).cast("double"), F.lit(0.0))
                + F.coalesce(F.max(F.when(~inner, F.col(c).cast("double") * F.col("share"))), F.lit(0.0))
            ).alias(c)
            for c in names
        ]
    )
    found = _cholesky(_moments(near, CONSISTENCY, "g", "start", "was"))
    spread = sum((F.log(f"l{i}{i}") for i in range(1, len(DIMS))), F.log("l00"))
    return found.withColumn("logdet", 2 * spread)


def concentrated(cells: DataFrame, steps: int = STEPS) -> DataFrame:
    """(g, m0.., c00.., logdet): of each group's starts, the half with the least determinant.

    A start is stepped until its determinant no longer falls (at most `steps` times). A step is
    one query that reads what fell in the step before, without a join with earlier ones.
    """
    params = stored(_cholesky(_starts(cells)).withColumn("logdet", F.lit(float("inf"))))
    columns = params.columns
    fallen = [params]
    for turn in range(steps):
        moving = fallen[-1]
        if turn == 2:
            # The starts that are best so far, if they still move; others stay at what they found.
            by = Window.partitionBy("g").orderBy("logdet", "start")
            found = [df.select("g", "start", "logdet", F.lit(k).alias("turn")) for k, df in enumerate(fallen)]
            last = reduce(DataFrame.unionByName, found).groupBy("g", "start").agg(F.min(F.struct("logdet", "turn")).alias("x"))
            best = last.select("g", "start", "x.*").withColumn("nth", F.row_number().over(by))
            ahead = best.where((F.col("nth") <= KEEP) & (F.col("turn") == turn)).select("g", "start")
            moving = stored(moving.join(ahead, ["g", "start"], "left_semi"))
        # Cut when it is read: below the aggregation the test would repeat the whole factor.
        fallen.append(stored(_concentrate(cells, moving)).where("logdet < was - 1e-6").select(*columns))
        if fallen[-1].isEmpty():
            break
    least = F.min(F.struct("logdet", "start", *[c for c in columns if c[0] in "mc"])).alias("x")
    done = stored(reduce(DataFrame.unionByName, fallen).groupBy("g").agg(least).select("g", "x.*").drop("start"))
    for table in fallen:
        forget(table)
    return done


def estimates(cells: DataFrame, steps: int = STEPS, prior: int = PRIOR) -> DataFrame:
    """(g, m0.., l00..) from weighted vectors (g, part, z1.., w); group '' holds all documents."""
    params = concentrated(cells, steps).drop("logdet")
    names = [c for c in params.columns if c != "g"]
    sizes = cells.groupBy("g").agg(F.sum("w").alias("w"))
    overall = params.where("g = ''").first()  # one record of numbers, or none without documents
    whole = lambda c: F.lit(overall[c] if overall else None).cast("double")
    large = F.col("w") >= LEAST
    blend = lambda c: F.when(large, (F.col(c) * F.col("w") + whole(c) * prior) / (F.col("w") + prior)).otherwise(whole(c))
    own = params.where("g <> ''").join(sizes, "g").select("g", *[blend(c).alias(c) for c in names])
    return stored(_cholesky(own))


def judge(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance2, text_hash.

    base_failed: fewer than ten words, or more than a fifth of the words in repeated windows.
    distance2 is null for those. Null and empty texts have no words and fail. A null language
    or source is a value like others. Rows are judged one by one, whatever their doc_id;
    any other column is ignored. Needs 2**63 > vectors squared times documents per group.
    """
    group = F.concat(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), F.lit("\n"), F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    )
    source = plain(documents, "doc_id", "text", "lang", "source")
    read = stored(
        source.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64("text").alias("text_hash"),
            group.alias("g"),
            counts(F.col("text")).alias("c"),
        )
        .select("doc_id", "text_hash", "g", "c.*")
        .withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
        .select("*", *_vector())
    )
    own = read.where("NOT base_failed").groupBy("g", *DIMS).agg(F.count("*").alias("w"))
    total = own.groupBy(*DIMS).agg(F.sum("w").alias("w")).select(F.lit("").alias("g"), *DIMS, "w")
    part = F.pmod(F.xxhash64(*DIMS), F.lit(PARTS)).cast("int")
    cells = stored(own.unionByName(total).withColumn("part", part))
    params = estimates(cells)
    far = distance(True)
    return (
        read.join(params, "g", "left")
        .withColumn("distance2", F.when(~F.col("base_failed"), far))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True)))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "distance2", "text_hash",
        )
    )
