"""Checks against other tables or profiles: the business registry, medians, number formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylint.functions import normalize as N
from paylint.operators.cells import KEYS, collected, issue
from paylint.operators.profiles import number_format
from paylint.operators.selection import percentiles


def snapshot(raw: DataFrame, now, hours: int = 24) -> DataFrame:
    """(b_no, b_stt, end_dt): the latest record of each ten-digit number, not older than `hours` before now.

    raw has b_no, b_stt, tax_type, end_dt and a timestamp _ts.
    """
    digits = raw.withColumn("b_no", N.digits(F.col("b_no"))).where(F.length("b_no") == 10).where(F.col("_ts") > F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))
    unknown = (F.coalesce(F.trim("b_stt"), F.lit("")) == "") & F.col("tax_type").contains("등록되지 않은")
    status = F.when(unknown, "국세청 미등록").otherwise(F.col("b_stt"))
    last = digits.groupBy("b_no").agg(F.max(F.struct("_ts", status.alias("b_stt"), "end_dt")).alias("r"))
    return last.select("b_no", "r.b_stt", "r.end_dt")


def registry_status(df: DataFrame, c: str, day: str, registry: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Issues for numbers with a right check digit whose registry record is bad or missing.

    A file and sheet without a single match has one BIZNO_REGISTRY_OUT row instead
    (row and value null). The registry is broadcast up to `rows` rows.
    """
    cell = F.col(f"`{c}`")
    valid = df.where(~N.is_blank(cell) & N.check_digit_ok(cell)).withColumn("_digits", N.digits(cell))
    book = registry.select("b_no", "b_stt", F.try_to_date("end_dt", "yyyyMMdd").alias("_closed")).dropDuplicates(["b_no"])
    book = F.broadcast(book) if book.limit(rows + 1).count() <= rows else book
    joined = valid.join(book, F.col("_digits") == F.col("b_no"), "left")
    out = joined.groupBy("_file", "_sheet").agg(F.count("b_no").alias("n")).where("n = 0").select("_file", "_sheet")
    paid = F.try_to_date(F.when(F.trim(f"`{day}`").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.trim(f"`{day}`")), "yyyy-MM-dd")
    stt, before = F.col("b_stt"), F.coalesce(F.col("_closed") < paid, F.lit(False))
    tests = [
        ("BIZNO_NOT_FOUND", "request", stt == "국세청 미등록"),
        ("BIZNO_SUSPENDED", "approval", stt == "휴업자"),
        ("BIZNO_CLOSED_BEFORE_SUPPORT", "request", (stt == "폐업자") & before),
        ("BIZNO_CLOSED_AFTER_SUPPORT", "approval", (stt == "폐업자") & ~before),
        ("BIZNO_UNVERIFIED", "approval", ~F.coalesce(stt.isin("계속사업자", "국세청 미등록", "휴업자", "폐업자"), F.lit(False))),
    ]
    found = collected(joined.join(out, ["_file", "_sheet"], "left_anti"), [issue(c, r, t, w) for r, t, w in tests])
    none = F.lit(None)
    down = out.select("_file", "_sheet", none.cast(df.schema["_row"].dataType).alias("_row"), F.lit(c).alias("column"), F.lit("BIZNO_REGISTRY_OUT").alias("rule_id"), F.lit("approval").alias("tier"), F.lit("rule").alias("kind"), none.cast("string").alias("value"), none.cast("string").alias("suggestion"), F.substring(F.sha2(F.concat_ws("|", F.lit("BIZNO_REGISTRY_OUT"), "_file", "_sheet"), 256), 1, 16).alias("issue_id"))
    return found.unionByName(down, allowMissingColumns=True)


def suspect_unit(df: DataFrame, c: str, times: float = 1000.0) -> DataFrame:
    """Amounts already in canonical form that are positive and below the median of their file and sheet by `times` or more; needs three readable amounts."""
    cell = F.col(f"`{c}`")
    rows = df.select(*KEYS, cell, N.amount(cell).alias("_x"))
    medians = percentiles(rows, ["_file", "_sheet"], F.col("_x"), [0.5]).where("n >= 3").select("_file", "_sheet", F.col("q0").alias("_median"))
    odd = rows.join(medians, ["_file", "_sheet"]).where((F.col("_x") > 0) & (F.col("_x").cast("string") == cell) & (F.col("_median") >= F.col("_x").cast("double") * times))
    return collected(odd, [issue(c, "AMOUNT_SUSPECT_UNIT", "approval", F.lit(True))])


def numeric_clean(c: Column) -> Column:
    """The whole number of a text without commas and units, scaled by the first of 억원, 만원 and 천원 that it has; null if none is left."""
    cell = F.trim(c)
    clean = F.regexp_replace(F.translate(N.half_width(cell), ",", ""), "억원|만원|천원|원|억|만|천", "")
    scale = F.when(cell.contains("억원"), 10**8).when(cell.contains("만원"), 10**4).when(cell.contains("천원"), 10**3).otherwise(1)
    return F.floor(F.trim(clean).try_cast("decimal(20,8)") * scale).cast("string")


def numeric_unit(df: DataFrame, c: str, plain: bool = False) -> DataFrame:
    """Numbers with misplaced commas, with or without commas against the column's habit, or with units in the text."""
    cell = F.trim(f"`{c}`")
    bare = F.translate(N.half_width(cell), ",", "")
    number, comma = bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), cell.contains(",")
    well = cell.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?$")
    value = bare.try_cast("decimal(30,8)")
    text = F.format_number(value, 0)
    with_commas = F.when(value == F.floor(value), text).otherwise(F.format_string("%s.%s", F.format_number(F.floor(value), 0), F.regexp_extract(bare, r"\.([0-9]+)$", 1)))
    whole = numeric_clean(cell)
    formats = number_format(df, c)
    rows = df.join(formats, ["_file", "_sheet"])
    commas = F.lit(False) if plain else F.col("format") == "comma"
    wrong = F.lit(plain)
    return collected(
        rows.where(cell != ""),
        [
            issue(c, "NUMERIC_UNIT", "auto", number & comma & ~well, suggestion=F.when(wrong, F.translate(cell, ",", "")).otherwise(with_commas)),
            issue(c, "NUMERIC_UNIT", "auto", number & comma & well & ~commas, suggestion=F.translate(cell, ",", "")),
            issue(c, "NUMERIC_UNIT", "auto", number & ~comma & commas, suggestion=with_commas),
            issue(c, "NUMERIC_UNIT", "auto", ~number & whole.isNotNull(), suggestion=whole),
        ],
    )
