"""What columns and files hold: templates, modal agencies, programs, columns that tell rows apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylint.functions import normalize as N


def profile_columns(matched: DataFrame, columns: DataFrame, definitions: DataFrame, rows: int = 100_000) -> DataFrame:
    """(file, sheet, column, kind, required, params): what the matched template says of a sheet's columns; unknown where it says nothing.

    matched: (file, sheet, standard), columns: (file, sheet, column), definitions:
    (standard, column, kind, required, params MAP), broadcast up to `rows` rows.
    """
    known = definitions.withColumnRenamed("column", "_column").withColumnRenamed("standard", "_standard")
    known = F.broadcast(known) if known.limit(rows + 1).count() <= rows else known
    joined = columns.join(matched.select("file", "sheet", "standard"), ["file", "sheet"], "left").join(known, F.expr("standard = _standard and column = _column"), "left")
    return joined.select("file", "sheet", "column", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("required", F.lit(False)).alias("required"), "params")


def match_standard(catalog: DataFrame, standards: DataFrame, least: float = 0.8) -> DataFrame:
    """(file, sheet, standard, ratio): for each sheet of catalog (file, sheet, column) the template of standards (standard, ord, column) with the most of its names there.

    Equal ratios go to the template that comes first; sheets below `least` have no row.
    """
    sizes = standards.groupBy("standard", "ord").agg(F.count_distinct("column").alias("size"))
    hits = catalog.select("file", "sheet", "column").distinct().join(standards, "column").groupBy("file", "sheet", "standard", "ord").agg(F.count_distinct("column").alias("n"))
    ratios = hits.join(sizes, ["standard", "ord"]).withColumn("ratio", F.col("n") / F.col("size")).where(F.col("ratio") >= least)
    best = ratios.groupBy("file", "sheet").agg(F.max(F.struct("ratio", (-F.col("ord")).alias("ord"), "standard")).alias("b"))
    return best.select("file", "sheet", F.col("b.standard").alias("standard"), F.col("b.ratio").alias("ratio"))


def agency_of_file(df: DataFrame, c: str = "기관명") -> DataFrame:
    """(_file, agency): the most frequent agency of a file, the smaller name of equals; without any, the file name up to its first underscore."""
    counts = df.select("_file", F.when(~N.is_blank(F.col(c)), F.col(c)).alias("agency")).groupBy("_file", "agency").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("_file").agg(F.min(F.when(F.col("agency").isNotNull(), F.struct((-F.col("n")).alias("n"), "agency"))).alias("b"))
    return best.select("_file", F.coalesce("b.agency", F.split("_file", "_")[0]).alias("agency"))


def program_names(df: DataFrame, c: str = "사업명") -> DataFrame:
    return df.select(F.trim(c).alias("program")).where(~N.is_blank(F.col("program"))).distinct()


def telling_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(_file, _sheet, column): columns with two or more different values, of which less than half are numbers."""
    t = df.select("_file", "_sheet", *(F.col(f"`{c}`") for c in columns)).unpivot(["_file", "_sheet"], columns, "column", "value").where("trim(value) != ''")
    number = F.trim(F.translate("value", ",", "")).rlike(r"^[+-]?([0-9０-９]+\.?[0-9０-９]*|\.[0-9０-９]+)([eE][+-]?[0-9]+)?$")
    stats = t.groupBy("_file", "_sheet", "column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_if(number).alias("numbers"))
    return stats.where("lo != hi and numbers * 2 < n").select("_file", "_sheet", "column")


def number_format(df: DataFrame, c: str) -> DataFrame:
    """(_file, _sheet, format): comma if more numbers have commas than not, else plain."""
    t = N.half_width(F.trim(f"`{c}`"))
    number = F.translate(t, ",", "").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    n = df.groupBy("_file", "_sheet").agg(F.count_if(number & t.contains(",")).alias("c"), F.count_if(number & ~t.contains(",")).alias("p"))
    return n.select("_file", "_sheet", F.when(F.col("c") > F.col("p"), "comma").otherwise("plain").alias("format"))
