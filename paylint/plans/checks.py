"""Registered queries of strict checks, serial dates and group places, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylint.operators import cells, decisions, strict
from paylint.plans.registry import _DUCK_VIEW, _ISSUES, _PAY, _issues, payments
from paylint.plans.review import _RIGHT
from paylint.sources.tables import saved


def c2_blank_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.collected(payments(spark, sf_dir), strict.blank_listed(["지원금액", "기관명"])).select("_file", "_row", "column", "rule_id", "tier")


def c13_strict_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.collected(payments(spark, sf_dir), strict.business_number("사업자번호")).select("_file", "_row", "tier", "value", "suggestion")


def c17_date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.collected(payments(spark, sf_dir), strict.date_format("지원일자")).select("_file", "_row", "tier", "value", "suggestion")


def c_short_years_and_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with two-digit years, and the amounts as if their header said 만원."""
    mark = F.element_at(F.array(F.lit("-"), F.lit("."), F.lit("/")), (F.col("_row") % 3 + 1).cast("int"))
    df = payments(spark, sf_dir).withColumn("지원일자", F.concat_ws("", F.substring("true_day", 3, 2), mark, F.substring("true_day", 6, 2), mark, F.substring("true_day", 9, 2)))
    period = ("2093-01-01", "2094-12-31")
    read = cells.parsed(df, ["지원금액"], ["지원일자"], {"지원금액": "만원"}, {"지원일자": period})
    return cells.collected(read, [*cells.amount("지원금액"), *cells.date("지원일자", *period)]).select("_file", "_row", "column", "rule_id", "tier", "value", "suggestion")


def s5_serial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days as day numbers; they are moved into the range of such numbers but for one region, and one sheet has too few."""
    day = F.date_diff(F.col("true_day").cast("date"), F.lit("1899-12-30").cast("date")) + F.when(F.col("_file") == "ASIA", 0).otherwise(9000)
    few = (F.col("_file") == "EUROPE") & (F.col("_row") % 3 != 0)
    df = payments(spark, sf_dir).select("_file", "_sheet", "_row", F.when(few | (F.col("_row") % 97 == 0), "-").otherwise(day.cast("string")).alias("지급일"))
    return strict.serial_dates(df, ["지급일"]).select("_file", "_row", F.col("지급일").alias("day"))


def g7_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payments(spark, sf_dir).select("사업명", "_file", "_sheet", "_row")
    return strict.group_rows(rows, ["사업명"]).withColumnRenamed("사업명", "program")


def d7_valid_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator types the present value of each cell with an amount or blank issue once more."""
    issues = saved(_issues(spark, sf_dir).where("rule_id in ('AMOUNT_NORMALIZE', 'BLANK')"))
    return decisions.valid_edits(issues.select("issue_id", "value"), issues).select("_file", "_row", "rule_id", "stored", "error")


def queries() -> dict:
    return {f.__name__: f for f in (c2_blank_listed, c13_strict_numbers, c17_date_format, c_short_years_and_units, s5_serial_dates, g7_group_rows, d7_valid_edits)}


def oracle_sql() -> dict[str, str]:
    return {
        "c2_blank_listed": _PAY + """SELECT _file, _row, '지원금액' AS "column", 'BLANK' AS rule_id, 'request' AS tier FROM keys WHERE "지원금액" = ''""",
        "c13_strict_numbers": _PAY
        + f""", v AS (SELECT *, coalesce({_RIGHT.replace('CAST(', 'TRY_CAST(')}, FALSE) AS ok FROM keys)
SELECT _file, _row, CASE WHEN ok THEN 'auto' ELSE 'approval' END AS tier, "사업자번호" AS value, CASE WHEN ok THEN company END AS suggestion FROM v WHERE NOT ok OR company <> "사업자번호" """,
        "c17_date_format": _PAY
        + """SELECT _file, _row, CASE WHEN o6 = 3 THEN 'approval' ELSE 'auto' END AS tier, "지원일자" AS value, CASE WHEN o6 <> 3 THEN true_day END AS suggestion FROM keys WHERE o6 <> 0""",
        "c_short_years_and_units": _PAY
        + """, m AS (SELECT *, CASE _row % 3 WHEN 0 THEN '-' WHEN 1 THEN '.' ELSE '/' END AS sep, '20' || substr(true_day, 3) AS day, (_row - 2) % 5 AS o5 FROM keys),
s AS (SELECT *, substr(day, 3, 2) || sep || substr(day, 6, 2) || sep || substr(day, 9, 2) AS d, day BETWEEN '2093-01-01' AND '2094-12-31' AS inside FROM m)
SELECT _file, _row, '지원일자' AS "column", 'DATE_NORMALIZE' AS rule_id, CASE WHEN inside OR substr(day, 9, 2) > '12' OR substr(day, 6, 2) = substr(day, 9, 2) THEN 'auto' ELSE 'approval' END AS tier, d AS value, day AS suggestion FROM s
UNION ALL SELECT _file, _row, '지원일자', 'DATE_OUT_OF_RANGE', 'request', day, NULL FROM s WHERE NOT inside
UNION ALL SELECT _file, _row, '지원금액', 'AMOUNT_NORMALIZE', CASE WHEN o5 IN (2, 3) THEN 'auto' ELSE 'approval' END, "지원금액", CASE WHEN "지원금액" = '0만' THEN '0' WHEN o5 IN (2, 3) THEN CAST(true_amount AS VARCHAR) ELSE CAST(true_amount * 10000 AS VARCHAR) END FROM s WHERE "지원금액" <> ''""",
        "s5_serial_dates": f"""WITH pay AS ({_DUCK_VIEW}), s AS (SELECT _file, _row, date_diff('day', DATE '1899-12-30', CAST(true_day AS DATE)) + CASE WHEN _file = 'ASIA' THEN 0 ELSE 9000 END AS n, (_file = 'EUROPE' AND _row % 3 <> 0) OR _row % 97 = 0 AS gone FROM pay)
SELECT _file, _row, CASE WHEN gone THEN '-' WHEN _file IN ('ASIA', 'EUROPE') THEN CAST(n AS VARCHAR) ELSE strftime(DATE '1899-12-30' + CAST(n AS INTEGER), '%Y-%m-%d') END AS day FROM s""",
        "d7_valid_edits": _ISSUES
        + """SELECT _file, _row, rule_id, suggestion AS stored, CASE WHEN value = '' THEN 'empty' WHEN suggestion IS NULL THEN 'unreadable' END AS error FROM found WHERE rule_id IN ('AMOUNT_NORMALIZE', 'BLANK')""",
        "g7_group_rows": f"""WITH pay AS ({_DUCK_VIEW}), r AS (SELECT "사업명" AS program, _file, _sheet, _row, row_number() OVER (PARTITION BY "사업명", _file, _sheet ORDER BY _row) AS k FROM pay),
s AS (SELECT program, _file, count(*) AS n, _file || ' · ' || _sheet || ' ' || string_agg(CAST(_row AS VARCHAR), ', ' ORDER BY _row) FILTER (k <= 8) || '행' || CASE WHEN count(*) > 8 THEN ' 외 ' || (count(*) - 8) || '행' ELSE '' END AS p FROM r GROUP BY program, _file, _sheet)
SELECT program, string_agg(_file, ', ' ORDER BY _file) AS files, string_agg(p, ' / ' ORDER BY _file) AS places, CAST(sum(n) AS BIGINT) AS n_rows FROM s GROUP BY program""",
    }
