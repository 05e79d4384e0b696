"""Process a folder again and again: only files that are new or changed are opened.

A manifest below the output has one entry per file and run that dealt with it. A run compares the
folder's listing with each file's last entry, lands what is new or changed below `run=<n>`, and
writes its entries at last: a run that breaks off leaves none, so the next one does the same work
again, under the same number, over what was left. Files that are gone get an entry that says so.
What a run landed stays where it is; `current` leaves out what later runs replaced.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetgrid.plans.pipeline import Options, check_output, land
from sheetgrid.sources.workbooks import workbook_files

MANIFEST_SCHEMA = "source_file string, modified timestamp, length long, state string, run int"
#: States of an entry.
NEW, CHANGED, GONE = "new", "changed", "gone"


def read_manifest(spark: SparkSession, output: str) -> DataFrame:
    """All entries of all runs into `output`; none before the first."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{output}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def last_entries(manifest: DataFrame) -> DataFrame:
    """Each file's entry of the latest run that dealt with it."""
    rest = F.struct("run", "modified", "length", "state")
    return manifest.groupBy("source_file").agg(F.max(rest).alias("_last")).select("source_file", "_last.*")


def changes(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_file, modified, length, state) of files that a run has to deal with.

    listing: (path, modificationTime, length). A file is changed if its time or its length differs
    from the last entry's, whichever way: a copy may bring an older time along.
    """
    known = last_entries(manifest).where(F.col("state") != GONE)
    now = listing.select(
        F.col("path").alias("source_file"), F.col("modificationTime").alias("_modified"), F.col("length").alias("_length")
    )
    same = (F.col("modified") == F.col("_modified")) & (F.col("length") == F.col("_length"))
    state = F.when(F.col("_length").isNull(), GONE).when(F.col("length").isNull(), NEW).when(~same, CHANGED)
    return (
        now.join(known, "source_file", "full")
        .withColumn("state", state)
        .where("state IS NOT NULL")
        .select(
            "source_file",
            F.coalesce("_modified", "modified").alias("modified"),
            F.coalesce("_length", "length").alias("length"),
            "state",
        )
    )


def process_changes(spark: SparkSession, path: str, output: str, options: Options = Options()) -> DataFrame | None:
    """Process the files under `path` that are new or changed since the last run into `output`.

    Returns the audit of this run, or None if there was nothing to do. Table sinks get the run's
    number as batch. The paths to open come to the driver, where Spark lists the folder anyway;
    contents of other files are not read. A file that changes while it is read is read
    again by the next run, as the manifest has what the listing said before.
    """
    check_output(options.output_format, options.database)
    manifest = read_manifest(spark, output)
    run = (manifest.agg(F.max("run")).first()[0] or 0) + 1
    listing = workbook_files(spark, path).select("path", "modificationTime", "length")
    changes(listing, manifest).write.mode("overwrite").parquet(f"{output}/changes/run={run}")
    found = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{output}/changes/run={run}").drop("run")
    if found.isEmpty():
        return None
    files = [r["source_file"] for r in found.where(F.col("state") != GONE).select("source_file").collect()]
    runs = None
    if files:
        content = spark.read.format("binaryFile").load([re.sub(r"([\\*?\[\]{},])", r"\\\1", f) for f in files])
        runs = land(content, output, options, f"run={run}", "overwrite", str(run))
    found.write.mode("overwrite").parquet(f"{output}/manifest/run={run}")
    return runs


def current(rows: DataFrame, manifest: DataFrame, run: str = "run") -> DataFrame:
    """The rows of each file's last run: no rows of files replaced since or gone, or of a run broken off.

    rows: what runs landed, with `source_file` and the number of the run in column `run` (`batch` in
    table sinks). Only replaced entries are joined; without any there is no join.
    """
    number = F.col(run).cast("int")
    last = manifest.agg(F.max("run")).first()[0] or 0
    rows = rows.where(number <= last)
    latest = last_entries(manifest).where(F.col("state") != GONE).select("source_file", "run")
    replaced = manifest.select("source_file", "run").join(latest, ["source_file", "run"], "left_anti")
    replaced = replaced.select(F.col("source_file").alias("_file"), F.col("run").alias("_run"))
    if replaced.isEmpty():
        return rows
    return rows.join(replaced, (F.col("source_file") == F.col("_file")) & (number == F.col("_run")), "left_anti")
