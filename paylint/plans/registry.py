"""Registered queries over the driver's tables, and their SQL.

The tables hold no payment sheets; a payments view with the quirks the checks look
for is made from orders, customers and nations, the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylint.functions import masking, normalize
from paylint.operators import cells, decisions, groups
from paylint.sources.tables import saved

COLUMNS = ["기관명", "사업명", "수혜기업명", "사업자번호", "지원일자", "지원금액"]

_VIEW = """
SELECT r_name AS _file, '실적' AS _sheet, o_orderkey + 2 AS _row, n_name AS `기관명`, o_orderpriority AS `사업명`, c_name AS `수혜기업명`,
  CASE WHEN c_custkey % 31 = 0 THEN substr(d, 1, 9) WHEN c_custkey % 5 = 0 THEN d || x
    ELSE substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6, 4) || x END AS `사업자번호`,
  CASE o_orderkey % 6 WHEN 0 THEN iso WHEN 1 THEN replace(iso, '-', '.') WHEN 2 THEN replace(iso, '-', '') WHEN 3 THEN substr(iso, 1, 4) || '년 ' || substr(iso, 6, 2) || '월 ' || substr(iso, 9, 2) || '일'
    WHEN 4 THEN iso || ' 10:20' ELSE substr(iso, 6, 2) || '/' || substr(iso, 9, 2) || '/' || substr(iso, 1, 4) END AS `지원일자`,
  CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN CASE WHEN won >= 1000 THEN CAST(won DIV 1000 AS STRING) || ',' || lpad(CAST(won % 1000 AS STRING), 3, '0') ELSE CAST(won AS STRING) END
    WHEN o_orderkey % 5 = 2 THEN CAST(won DIV 10000 AS STRING) || '만' WHEN o_orderkey % 5 = 3 THEN CAST(won AS STRING) || '원'
    WHEN o_orderkey % 5 = 4 THEN translate(CAST(won AS STRING), '0123456789', '０１２３４５６７８９') ELSE CAST(won AS STRING) END AS `지원금액`,
  iso AS true_day, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 5 = 2 AND won < 10000 THEN CAST(NULL AS BIGINT) WHEN o_orderkey % 5 = 2 THEN won DIV 10000 * 10000 ELSE won END AS true_amount
FROM (SELECT *, CAST((10 - (t % 10)) % 10 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS INT) % 10 AS x FROM (
  SELECT *, CAST(substr(d, 1, 1) AS INT) + 3 * CAST(substr(d, 2, 1) AS INT) + 7 * CAST(substr(d, 3, 1) AS INT) + CAST(substr(d, 4, 1) AS INT) + 3 * CAST(substr(d, 5, 1) AS INT) + 7 * CAST(substr(d, 6, 1) AS INT)
    + CAST(substr(d, 7, 1) AS INT) + 3 * CAST(substr(d, 8, 1) AS INT) + 5 * CAST(substr(d, 9, 1) AS INT) + (5 * CAST(substr(d, 9, 1) AS INT)) DIV 10 AS t
  FROM (SELECT *, lpad(CAST(100000000 + c_custkey * 7919 AS STRING), 9, '0') AS d, CAST(floor(o_totalprice) AS BIGINT) AS won, DAY_OF AS iso
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) a) b) c
"""
_SPARK_VIEW = _VIEW.replace("DAY_OF", "date_format(o_orderdate, 'yyyy-MM-dd')")
_DUCK_VIEW = _VIEW.replace("DAY_OF", "strftime(o_orderdate, '%Y-%m-%d')").replace("`", '"').replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation", "region")}
    return spark.sql(_SPARK_VIEW.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}").replace("JOIN nation", "JOIN {nation}").replace("JOIN region", "JOIN {region}"), **tables)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = ("1993-01-01", "1996-12-31")
    df = cells.parsed(payments(spark, sf_dir), ["지원금액"], ["지원일자"], periods={"지원일자": period}, blanks=COLUMNS, numbers=["사업자번호"])
    return cells.collected(df, [*cells.blank(df, COLUMNS, COLUMNS), *cells.amount("지원금액", df), *cells.date("지원일자", *period, df), *cells.business_number("사업자번호", df)])


def g3_sum_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.sum_limit(payments(spark, sf_dir), ["사업자번호"], 400_000, "per_business").select(F.col("사업자번호").alias("company"), F.col("사업명").alias("program"), "year", F.col("total").cast("long").alias("total"), F.col("excess").cast("long").alias("excess"), "n_rows")


def g1_max_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.max_count(payments(spark, sf_dir), ["사업자번호", "사업명"]).select(F.col("사업자번호").alias("company"), F.col("사업명").alias("program"), "year", "n", "first_row")


def g4_payment_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.payment_limit(payments(spark, sf_dir), 300_000).select("_file", "_row", F.col("사업자번호").alias("company"), F.col("amount").cast("long").alias("amount"))


def g2_near_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = groups.near_payments(payments(spark, sf_dir).withColumn("지원금액", F.concat(F.substring("지원금액", 1, 1), F.lit("0000"))), ["사업명", "기관명"], 3)
    return near.select(F.col("사업명").alias("program"), F.col("기관명").alias("agency"), F.col("amount").cast("long").alias("amount"), "n_rows", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n_files")


def n_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, dates and numbers as the normalisers read them."""
    df = payments(spark, sf_dir)
    return df.select("_file", "_row", F.coalesce(normalize.amount(F.col("지원금액")).cast("long"), F.lit(-1).cast("long")).alias("amount"), normalize.date(F.col("지원일자"))["value"].cast("string").alias("day"), normalize.year(F.col("지원일자")).alias("year"), F.coalesce(normalize.check_digit_ok(F.col("사업자번호")), F.lit(False)).alias("digit_ok"), normalize.business_key(F.col("사업자번호")).alias("company"))


def k_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = payments(spark, sf_dir)
    return df.select("_file", "_row", masking.business_number(F.col("사업자번호")).alias("number"), masking.business_cell(F.col("사업자번호")).alias("cell"))


def k7_masked_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(masking.contacts(F.col("text"))).alias("masked"))


def c_cell_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).select("_file", "_row", "column", "rule_id", "tier", "value", "suggestion")


def c22_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return cells.outlier(lines, "l_extendedprice", ["l_returnflag"], 0.2).select("l_orderkey", "l_linenumber", "l_returnflag", "outlier")


def c21_type_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.type_consistency(payments(spark, sf_dir), "지원금액").select("_file", "_row", "value")


def c14_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = payments(spark, sf_dir)
    codes = df.where("substr(`사업명`, 1, 1) < '4'").select(F.col("사업명").alias("code")).distinct()
    return cells.code(df, "사업명", codes).select("_file", "_row", "value")


def r1_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = payments(spark, sf_dir).select("_file", "_sheet", "_row", "기관명", "사업명", F.substring("지원일자", 1, 7).alias("지원일자"))
    return cells.duplicate_rows(df, ["기관명", "사업명", "지원일자"]).select("_file", "_row", "value", "first_file", "first_row")


def d3_system_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = decisions.escalated(saved(_issues(spark, sf_dir)))
    return decisions.system_decisions(issues).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def d6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = payments(spark, sf_dir)
    changed = decisions.changes(_issues(spark, sf_dir))
    return decisions.cleaned(df, changed, COLUMNS).select("_file", "_row", F.col("사업자번호").alias("company"), F.col("지원금액").alias("amount"))


def m2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.summary(_issues(spark, sf_dir))


def m3_file_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.file_tiers(_issues(spark, sf_dir))


def m4_top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.top_rules(_issues(spark, sf_dir))


def queries() -> dict:
    all_ = (g3_sum_limit, g1_max_count, g4_payment_limit, g2_near_payments, n_normalized, k_masked, k7_masked_contacts, c_cell_issues, c22_outliers, c21_type_consistency, c14_codes, r1_duplicate_rows, d3_system_decisions, d6_cleaned, m2_summary, m3_file_tiers, m4_top_rules)
    return {f.__name__: f for f in all_}


_PAY = f"""WITH pay AS ({_DUCK_VIEW}), keyed AS (SELECT *, regexp_replace("사업자번호", '[^0-9]', '', 'g') AS dg, substr(true_day, 1, 4) AS y FROM pay),
keys AS (SELECT *, CASE WHEN length(dg) = 10 THEN substr(dg, 1, 3) || '-' || substr(dg, 4, 2) || '-' || substr(dg, 6) ELSE "사업자번호" END AS company,
  CASE WHEN o6 = 5 THEN y WHEN TRUE THEN y END AS year FROM (SELECT *, (_row - 2) % 6 AS o6 FROM keyed))
"""
_ISSUES = (
    _PAY
    + """, found AS (
SELECT _file, _row, '지원금액' AS "column", 'BLANK' AS rule_id, 'request' AS tier, "지원금액" AS value, NULL AS suggestion FROM keys WHERE "지원금액" = ''
UNION ALL SELECT _file, _row, '지원금액', 'AMOUNT_NORMALIZE', 'approval', "지원금액", NULL FROM keys WHERE "지원금액" <> '' AND true_amount IS NULL AND "지원금액" <> '0만'
UNION ALL SELECT _file, _row, '지원금액', 'AMOUNT_NORMALIZE', 'auto', "지원금액", '0' FROM keys WHERE "지원금액" = '0만'
UNION ALL SELECT _file, _row, '지원금액', 'AMOUNT_NORMALIZE', 'auto', "지원금액", CAST(true_amount AS VARCHAR) FROM keys WHERE true_amount IS NOT NULL AND CAST(true_amount AS VARCHAR) <> "지원금액"
UNION ALL SELECT _file, _row, '지원일자', 'DATE_NORMALIZE', CASE WHEN o6 = 5 AND CAST(substr(true_day, 9, 2) AS INT) <= 12 THEN 'approval' ELSE 'auto' END, "지원일자", true_day FROM keys WHERE o6 <> 0
UNION ALL SELECT _file, _row, '지원일자', 'DATE_OUT_OF_RANGE', 'request', true_day, NULL FROM keys WHERE true_day NOT BETWEEN '1993-01-01' AND '1996-12-31'
UNION ALL SELECT _file, _row, '사업자번호', 'BIZNO_FORMAT', 'request', "사업자번호", NULL FROM keys WHERE length(dg) <> 10
UNION ALL SELECT _file, _row, '사업자번호', 'BIZNO_VERIFY', 'auto', "사업자번호", company FROM keys WHERE length(dg) = 10 AND company <> "사업자번호"
UNION ALL SELECT _file, _row, '사업자번호', 'BIZNO_CHECKSUM', 'approval', "사업자번호", NULL FROM keys WHERE length(dg) = 10 AND
  (10 - (CAST(dg[1] AS INT) + 3 * CAST(dg[2] AS INT) + 7 * CAST(dg[3] AS INT) + CAST(dg[4] AS INT) + 3 * CAST(dg[5] AS INT) + 7 * CAST(dg[6] AS INT) + CAST(dg[7] AS INT) + 3 * CAST(dg[8] AS INT) + 5 * CAST(dg[9] AS INT) + 5 * CAST(dg[9] AS INT) // 10) % 10) % 10 <> CAST(dg[10] AS INT))
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "g3_sum_limit": _PAY + 'SELECT company, "사업명" AS program, year, CAST(sum(true_amount) AS BIGINT) AS total, CAST(sum(true_amount) - 400000 AS BIGINT) AS excess, count(*) AS n_rows FROM keys GROUP BY ALL HAVING sum(true_amount) > 400000',
        "g1_max_count": _PAY + 'SELECT company, "사업명" AS program, year, count(*) AS n, min(_row) AS first_row FROM keys GROUP BY ALL HAVING count(*) > 1',
        "g4_payment_limit": _PAY + "SELECT _file, _row, company, true_amount AS amount FROM keys WHERE true_amount > 300000",
        "g2_near_payments": _PAY
        + """, a AS (SELECT _file, _row, "사업명" AS program, "기관명" AS agency, CAST(true_day AS DATE) AS day, CAST(translate(substr("지원금액", 1, 1), '０１２３４５６７８９', '0123456789') || '0000' AS BIGINT) AS amount FROM keys),
b AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) <= 3 THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS (PARTITION BY program, agency, amount ORDER BY day, _file, _row)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY program, agency, amount ORDER BY day, _file, _row ROWS UNBOUNDED PRECEDING) AS chain FROM b)
SELECT program, agency, amount, count(*) AS n_rows, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(DISTINCT _file) AS n_files FROM c GROUP BY program, agency, amount, chain HAVING count(*) > 1""",
        "n_normalized": _PAY
        + """SELECT _file, _row, coalesce(CASE WHEN "지원금액" = '0만' THEN 0 ELSE true_amount END, -1) AS amount, true_day AS day, year, coalesce(CASE WHEN length(dg) = 10 THEN
  (10 - (CAST(dg[1] AS INT) + 3 * CAST(dg[2] AS INT) + 7 * CAST(dg[3] AS INT) + CAST(dg[4] AS INT) + 3 * CAST(dg[5] AS INT) + 7 * CAST(dg[6] AS INT) + CAST(dg[7] AS INT) + 3 * CAST(dg[8] AS INT) + 5 * CAST(dg[9] AS INT) + 5 * CAST(dg[9] AS INT) // 10) % 10) % 10 = CAST(dg[10] AS INT) END, FALSE) AS digit_ok, company FROM keys""",
        "k_masked": _PAY + "SELECT _file, _row, CASE WHEN length(dg) = 10 THEN substr(dg, 1, 3) || '-' || substr(dg, 4, 2) || '-*****' ELSE \"사업자번호\" END AS number, substr(dg, 1, 3) || '-' || substr(dg, 4, 2) || '-' || repeat('*', length(dg) - 5) AS cell FROM keys",
        "c_cell_issues": _ISSUES + "SELECT * FROM found",
        "c22_outliers": """WITH s AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1 HAVING count(*) >= 4),
o AS (SELECT l_orderkey, l_linenumber, l.l_returnflag AS l_returnflag, CASE WHEN m > 0 AND l_extendedprice > m * 5 THEN 'mean' WHEN l_extendedprice < q1 - 0.2 * (q3 - q1) THEN 'low' WHEN l_extendedprice > q3 + 0.2 * (q3 - q1) THEN 'high' END AS outlier FROM lineitem l JOIN s ON l.l_returnflag = s.l_returnflag)
SELECT * FROM o WHERE outlier IS NOT NULL""",
        "c21_type_consistency": _PAY
        + """, k AS (SELECT _file, _row, "지원금액" AS value, CASE WHEN regexp_full_match("지원금액", '[0-9]+') THEN 'numeric' ELSE 'text' END AS kind FROM keys WHERE "지원금액" <> ''),
n AS (SELECT _file, kind, count(*) AS n, min(_row) AS f FROM k GROUP BY ALL), t AS (SELECT _file, arg_max(kind, n * 100000000 - f) AS top FROM n GROUP BY _file)
SELECT k._file AS _file, _row, value FROM k JOIN t ON k._file = t._file WHERE kind <> top""",
        "c14_codes": _PAY + """SELECT _file, _row, "사업명" AS value FROM keys WHERE substr("사업명", 1, 1) >= '4'""",
        "r1_duplicate_rows": _PAY
        + """, r AS (SELECT _file, _row, row_number() OVER w AS n, first_value(_file) OVER w AS first_file, first_value(_row) OVER w AS first_row FROM keys WINDOW w AS (PARTITION BY "기관명", "사업명", substr("지원일자", 1, 7) ORDER BY _file, _row))
SELECT _file, _row, CASE WHEN first_file = _file THEN '(완전중복)' ELSE '(파일간중복)' END AS value, first_file, first_row FROM r WHERE n > 1""",
        "d3_system_decisions": _ISSUES + "SELECT CASE WHEN tier = 'auto' THEN 'apply' ELSE 'request' END AS action, count(*) AS n FROM found WHERE tier <> 'approval' GROUP BY 1",
        "d6_cleaned": _PAY + """SELECT _file, _row, company, CASE WHEN "지원금액" = '0만' THEN '0' ELSE coalesce(CAST(true_amount AS VARCHAR), "지원금액") END AS amount FROM keys""",
        "m2_summary": _ISSUES + "SELECT 'tier' AS kind, tier AS item, count(*) AS n FROM found GROUP BY tier UNION ALL SELECT 'rule', rule_id, count(*) FROM found GROUP BY rule_id UNION ALL SELECT 'file', _file, count(*) FROM found GROUP BY _file",
        "m3_file_tiers": _ISSUES + "SELECT _file, count(*) FILTER (tier = 'auto') AS auto, count(*) FILTER (tier = 'approval') AS approval, count(*) FILTER (tier = 'request') AS request, count(*) AS total FROM found GROUP BY _file",
        "m4_top_rules": _ISSUES + "SELECT rule_id, count(*) AS n FROM found GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 5",
    }
