"""Large JSON files that are one list of objects, read in splits: no task reads a file whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylint.sources.tables import saved


def _before(df: DataFrame, name: str, value: Column, out: str) -> DataFrame:
    """df with `out`: the sum of value over all pieces of the file before each.

    Pieces are summed inside a split, and the sums of the splits of a file, one row each, put one after another.
    """
    inside = Window.partitionBy("_file", "_start").orderBy("_id")
    summed = saved(df.withColumn(name, value).withColumn(f"_{out}", F.sum(name).over(inside) - F.col(name)))
    totals = summed.groupBy("_file", "_start").agg(F.sum(name).alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy("_file").orderBy("_start")) - F.col("_n")
    starts = totals.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), so_far.alias("_o"))
    return summed.join(starts, F.expr("_file = _f and _start = _s")).withColumn(out, F.col(f"_{out}") + F.col("_o")).drop("_f", "_s", "_o", f"_{out}")


def load_json_array(spark: SparkSession, paths: list[str], name: str = "_metadata.file_name") -> DataFrame:
    """(_file, _sheet, _row, record VARIANT): the objects of files whose root is a list, as load_json() gives them.

    Files are cut behind each ``}``, wherever it is, by Spark's splittable text
    reader.  How many quotes stand before a piece tells whether it begins inside
    a string, how many brackets outside strings how deep it is nested, and how
    many objects have ended at the root's depth to which record it belongs; these are
    sums over pieces, see _before().  The pieces of one record meet in one task.

    Elements of the list that are no objects have no place of their own here, files of other
    shapes no right result: unsupported_json() lists both.  name: SQL for what
    tells files apart.
    """
    raw = spark.read.text(paths, lineSep="}")
    pieces = raw.select(F.col("value"), F.expr(name).alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    # escapes stand inside strings alone, and never for a bracket that closes an object
    clean = F.regexp_replace("value", r"\\.", "")
    quotes = lambda c: F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))
    quoted = _before(pieces.withColumn("_clean", clean), "_quotes", quotes(F.col("_clean")), "_opened")
    inside, ends_inside = F.col("_opened") % 2 == 1, (F.col("_opened") + F.col("_quotes")) % 2 == 1
    mark = lambda when: F.when(when, '"').otherwise("")
    bare = F.regexp_replace(F.concat(mark(inside), "_clean", mark(ends_inside)), '"[^"]*"', "")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    closes = (~ends_inside).cast("int")
    step = count(F.col("_bare"), "{") + count(F.col("_bare"), "[") - count(F.col("_bare"), "]") - closes
    nested = _before(quoted.withColumn("_bare", bare), "_step", step, "_depth")
    ends = ((closes == 1) & (F.col("_depth") + F.col("_step") == 1)).cast("int")
    told = _before(nested, "_ends", ends, "_record")
    # the text behind a file's last object closes the list and belongs to none
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_id", "value"))), lambda p: p["value"]), "}")
    records = told.groupBy("_file", "_record").agg(text.alias("text"), F.max("_ends").alias("whole")).where("whole = 1")
    first = F.regexp_replace("text", r"^[\s\[,]+", "")
    parsed = records.select("_file", F.lit("root").alias("_sheet"), (F.col("_record") + 2).cast("long").alias("_row"), F.try_parse_json(F.concat(first, F.lit("}"))).alias("record"))
    return parsed.where("record is not null")
