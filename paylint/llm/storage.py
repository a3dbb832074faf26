"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset on a local master (tests), a folder of our own, set for the session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows of an Arrow batch, at most: with texts of some kilobytes a batch has some megabytes.
BATCH = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH: workers hold whole batches of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if not 0 < rows <= BATCH:
        spark.conf.set(key, BATCH)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front that no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs nothing already written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from saved() that no later plan reads."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        at = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
