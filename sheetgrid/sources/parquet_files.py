"""Inventory and health of the files in a Parquet folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOOTER_SCHEMA = (
    "path string, file_size long, num_rows long, num_columns int, num_row_groups int,"
    " schema string, created_by string, format_version string, error string"
)


def _footer(path: str, size: int) -> tuple:
    import pyarrow.parquet as pq
    from pyarrow import fs

    try:
        if path.startswith("file:"):
            filesystem, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            filesystem, name = fs.FileSystem.from_uri(quote(path, safe=":/"))
        with filesystem.open_input_file(name) as stream:
            meta = pq.ParquetFile(stream).metadata
        return (
            path,
            size,
            meta.num_rows,
            meta.num_columns,
            meta.num_row_groups,
            str(meta.schema).partition("\n")[2],
            meta.created_by,
            meta.format_version,
            None,
        )
    except Exception as error:  # a damaged file is a record, not a failed job
        return (path, size, None, None, None, None, None, None, str(error) or type(error).__name__)


def footer_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One record per Parquet file, from its footer; no data page is read.

    The listing leaves out the content column, so each task opens only the
    footers of its files. Damaged files carry the reason in `error`.
    """
    names = [part.split()[0] for part in FOOTER_SCHEMA.split(", ")]
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_footer(p, n) for p, n in zip(batch["path"], batch["length"])]
            frame = pd.DataFrame(rows, columns=names, dtype=object)
            yield frame

    return files.mapInPandas(read, FOOTER_SCHEMA)


def _holds_value(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def _plain(path: Column) -> Column:
    """Path comparable between a listing and `_metadata`."""
    return F.regexp_replace(path, "^file:/+", "/")


def _decoded(path: Column) -> Column:
    """`_metadata` gives paths percent-encoded, with `+` as it is."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def parquet_health(spark: SparkSession, path: str) -> DataFrame:
    """(path, num_rows, is_readable, is_empty, is_all_null, is_valid) per file.

    A file is valid when its footer and all its rows can be read and some value
    is not null. One job checks the whole folder; files without rows and
    damaged ones come from the footers.
    """
    data = (
        spark.read.option("ignoreCorruptFiles", "true")
        .option("mergeSchema", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(path)
    )
    some = reduce(lambda a, b: a | b, [_holds_value(f) for f in data.schema.fields])
    scanned = (
        data.select(F.col("_metadata.file_path").alias("_file"), some.alias("_some"))
        .groupBy("_file")
        .agg(F.count(F.lit(1)).alias("_rows"), F.bool_or("_some").alias("_filled"))
        .select(_plain(_decoded(F.col("_file"))).alias("_key"), "_rows", "_filled")
    )
    footers = footer_inventory(spark, path).select(
        "path", "num_rows", "error", _plain(F.col("path")).alias("_key")
    )
    rows = F.coalesce(F.col("_rows"), F.lit(0))
    readable = F.col("error").isNull() & (rows == F.col("num_rows"))
    checked = footers.join(scanned, "_key", "left").select(
        "path",
        "num_rows",
        F.coalesce(readable, F.lit(False)).alias("is_readable"),
        F.coalesce(F.col("num_rows") == 0, F.lit(False)).alias("is_empty"),
        ((rows > 0) & ~F.coalesce("_filled", F.lit(False))).alias("is_all_null"),
    )
    return checked.withColumn(
        "is_valid", F.col("is_readable") & ~F.col("is_empty") & ~F.col("is_all_null")
    )
