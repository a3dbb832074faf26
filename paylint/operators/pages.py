"""Pages of a long list by an index of its ranges: a page reads the part that it lies in, not all that comes before."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylint.sources.tables import saved

#: Rows of a part, and of a range, which has one part or more, about.
PART_ROWS = 200_000


def write_pages(df: DataFrame, path: str, order: list[str], part_rows: int = PART_ROWS) -> None:
    """Write df in parts of rising ranges of its order. The order must tell rows apart, or equal rows may change places.

    Small parts share a range, so that there are neither tasks nor files for each of them;
    a range has a folder (part) and is in order in its file, where a page finds its
    part (_piece) by the file's statistics.
    """
    df, by = saved(df), [F.col(f"`{c}`").asc_nulls_first() for c in order]
    total = df.count()
    ranged = df.repartitionByRange(max(1, -(-total // max(part_rows, PART_ROWS))), *by).withColumn("part", F.spark_partition_id())
    at = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    out = ranged.withColumn("_piece", F.floor(at / part_rows)).write
    # without rows there is no folder that would keep the columns
    (out.partitionBy("part") if total else out).parquet(path)


class Pages:
    """A table from write_pages() and how many rows each of its parts has: a number for each part comes to the driver, read from the files' footers."""

    def __init__(self, spark: SparkSession, path: str, order: list[str]):
        self.rows, self.order = spark.read.parquet(path), order
        counts = sorted(((r["part"], r["_piece"]), r["count"]) for r in self.rows.groupBy("part", "_piece").count().collect())
        self.parts, self.ends = [p for p, _ in counts], list(accumulate(n for _, n in counts))

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def page(self, number: int, rows: int = 50) -> DataFrame:
        """Rows number * rows and on, at most `rows`, with their place in the list from 0; no part but theirs is read."""
        first, last = number * rows, min((number + 1) * rows, self.total) - 1
        if first > last:
            return self.rows.drop("part", "_piece").withColumn("place", F.lit(0).cast("long")).limit(0)
        a, z = bisect_right(self.ends, first), bisect_right(self.ends, last)
        begins = {self.parts[i]: self.ends[i - 1] if i else 0 for i in range(a, z + 1)}
        key = F.struct("part", "_piece")
        some = self.rows.where(F.col("part").isin([p for p, _ in begins]) & F.col("_piece").isin([q for _, q in begins]))
        start = F.element_at(F.create_map(*(x for (p, q), n in begins.items() for x in (F.struct(F.lit(p).alias("part"), F.lit(q).cast("long").alias("_piece")), F.lit(n)))), key)
        place = F.row_number().over(Window.partitionBy("part", "_piece").orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in self.order))) - 1 + start
        return some.withColumn("place", place.cast("long")).where(F.col("place").between(first, last)).drop("part", "_piece")
