"""Runs that are published as a whole: what a run writes is seen when its commit row is there, and not before.

A store is a folder with a table for each kind (issues, changes, cleaned, groups,
reports), in folders by attempt, and a table of commits.  A run writes its tables
under an attempt of its own and then adds one commit row, a single small file that
Spark's committer renames into place.  Readers join the commits, so a run that broke
off, or was tried twice, shows the attempt that was committed first or nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "run_id string, attempt string, at timestamp, kinds array<string>"


class Run:
    """One attempt at a run: write() its tables, then commit()."""

    def __init__(self, spark: SparkSession, store: str, run_id: str):
        self.spark, self.store, self.run_id, self.attempt, self.kinds = spark, store.rstrip("/"), run_id, uuid.uuid4().hex, []

    def write(self, kind: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.store}/{kind}/attempt={self.attempt}")
        self.kinds.append(kind)

    def commit(self) -> None:
        """Publish what was written. Only now do readers see the run."""
        row = self.spark.createDataFrame([(self.run_id, self.attempt, self.kinds)], "run_id string, attempt string, kinds array<string>")
        row.select("run_id", "attempt", F.current_timestamp().alias("at"), "kinds").coalesce(1).write.mode("append").parquet(f"{self.store}/commits")


def commits(spark: SparkSession, store: str) -> DataFrame:
    """(run_id, attempt, at, kinds): the first committed attempt of each run."""
    try:
        every = spark.read.schema(_COMMITS).parquet(f"{store.rstrip('/')}/commits")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        every = spark.createDataFrame([], _COMMITS)
    return every.groupBy("run_id").agg(F.min_by(F.struct("attempt", "at", "kinds"), F.struct("at", "attempt")).alias("c")).select("run_id", "c.*")


def runs(spark: SparkSession, store: str, limit: int = 20) -> DataFrame:
    """The latest published runs, newest first."""
    return commits(spark, store).select("run_id").orderBy(F.desc("run_id")).limit(limit)


def table(spark: SparkSession, store: str, kind: str, run_id: str | None = None) -> DataFrame:
    """A kind's rows of published runs, or of one, with run_id. Folders of other attempts are not read."""
    seen = commits(spark, store).where(F.array_contains("kinds", kind))
    seen = seen if run_id is None else seen.where(F.col("run_id") == run_id)
    rows = spark.read.parquet(f"{store.rstrip('/')}/{kind}")
    return rows.join(F.broadcast(seen.select("run_id", "attempt")), "attempt").drop("attempt")


def loaded_issues(spark: SparkSession, store: str, run_id: str) -> DataFrame:
    """A run's issues: empty texts are null, rows without an identifier, a rule or a readable row number are left out."""
    df = table(spark, store, "issues", run_id)
    clean = df.select(*((F.nullif(F.col(f"`{c}`"), F.lit("")) if k == "string" else F.col(f"`{c}`")).alias(c) for c, k in df.dtypes))
    return clean.withColumn("_row", F.col("_row").try_cast("long")).where("issue_id is not null and rule_id is not null and _row is not null")


def groups_with_dispositions(spark: SparkSession, store: str, run_id: str, log: DataFrame) -> DataFrame:
    """A run's saved groups (masked before they were saved), each with its last disposition by seq of log (group_id, disposition, seq), request without one."""
    last = log.groupBy("group_id").agg(F.max_by("disposition", F.struct("seq", "disposition")).alias("disposition"))
    saved = table(spark, store, "groups", run_id)
    return saved.join(last, "group_id", "left").withColumn("disposition", F.coalesce("disposition", F.lit("request")))
