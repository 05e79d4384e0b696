"""Shared steps of the corpus operators: stored tables, components, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words, as a Java and DuckDB pattern.
SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a session on this machine alone may go without one: it gets its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back.

    Cuts the lineage: whatever an executor loses later is read again from there. Reading
    with the known schema needs no footer, and an empty table reads back empty.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a `stored` table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/llm/" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of a table; other columns, whatever their names, play no part."""
    return df.select(*[df[f"`{name}`"] for name in names])


def boxed(df: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows in one column `doc` beside key columns, so that no other name can clash.

    ``select("doc.*")`` gives the rows back.
    """
    whole = F.struct(*[df[f"`{name}`"] for name in df.columns]).alias("doc")
    return df.select(whole, *[key.alias(name) for name, key in keys.items()])


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, component), component = smallest node reachable.

    `edges` has long columns a and b; nodes without edges are absent. Alternates the large
    and the small star step until the edges stay the same. A step aggregates and
    joins per node, so a node with many edges is merged map-side in the aggregation
    and split by the join; no list of neighbours is ever formed. Each step's edges
    are written to the shared folder and the step before is deleted.
    """
    a, b = F.col("a"), F.col("b")
    current = stored(
        edges.where("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    state = _fingerprint(current)
    while state[0]:
        large = _star(current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        small = _star(large, False)
        forget(current)
        forget(large)
        current, before, state = small, state, _fingerprint(small)
        if state == before:
            break
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over pairs (u, v); pairs come out with u > v.

    large: `edges` holds both directions; each neighbour above u is tied to the smallest
    node around u. small: u > v; the neighbours below u and u are tied to the smallest.
    """
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    met = edges.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
    done = stored(out.distinct())
    forget(least)
    return done


def running(
    df: DataFrame, keys: list[str], weight: Column, order: list[Column], spread: Column, rows: int, name: str
) -> DataFrame:
    """Add `name`: the sum of `weight` over the rows before this one within equal `keys`.

    With weight 1 that is a rank from 0. Rows are dealt by `spread` (a hash of the row) into
    parts of about 65,536, so that a key with a third of all rows is many groups. Sums
    run through part 0, then part 1 and so on; within a part by `order`. Only one
    record per key and part meets per key. Null keys are a key of their own.
    """
    parts = max(1, -(-rows // 65536))
    df = df.withColumn("_part", F.pmod(spread, F.lit(parts)).cast("int")).withColumn("_w", weight.cast("long"))
    by_key = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        df.groupBy(*keys, "_part")
        .agg(F.sum("_w").alias("_sum"))
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col("_part").alias("_p"),
            F.coalesce(F.sum("_sum").over(by_key), F.lit(0)).alias("_before"),
        )
    )
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        df.withColumn("_own", F.coalesce(F.sum("_w").over(own), F.lit(0)))
        .join(before, same)
        .withColumn(name, F.col("_before") + F.col("_own"))
        .drop("_part", "_w", "_own", "_p", "_before", *[f"_k_{k}" for k in keys])
    )
