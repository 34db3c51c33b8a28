"""Writing tables, and keeping a table that several later steps read."""

import uuid

from pyspark.sql import Observation


def save(df, path, fmt="parquet", mode="overwrite", partition_by=()):
    """Write a table. Text formats get a header; no row-number column is added."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def keep(df, path):
    """Save a table that several later steps read, and read it back.

    `path` is a new folder that all executors share. The copy is Parquet, so later
    steps read only the columns and rows they need; it is the caller's to delete.
    """
    save(df, path, mode="error")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_observed(df, path, *measures):
    """`keep`, and what the aggregates `measures` gave while the table was written, as a dictionary.

    Smallest and largest values don't change if a lost task runs again; sums and counts may.
    """
    seen = Observation()
    kept = keep(df.observe(seen, *measures), path)
    return kept, seen.get


def keep_bucketed(df, path, key, buckets):
    """Save a table in `buckets` buckets of a column, so joins and windows by it need no shuffle.

    The files are in `path`, as for `keep`; the session's catalog knows them under a new name. Drop
    that table (`DataFrame.inputFiles` tells the files) when it is no longer read.
    """
    name = f"letterflow_{uuid.uuid4().hex}"
    df.write.mode("error").format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return df.sparkSession.table(name)


def new_folder(spark, name):
    """Name of a new folder below `spark.checkpoint.dir`, or else the session's warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/letterflow-{uuid.uuid4().hex}/{name}"
