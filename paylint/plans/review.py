"""More registered queries: profiles, the registry, rules from a master table, wildcards, marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylint.functions import masking
from paylint.functions import normalize as N
from paylint.operators import cells, decisions, groups, profiles, registered, reports
from paylint.plans.registry import _DUCK_VIEW, _ISSUES, _PAY, COLUMNS, _issues, payments
from paylint.sources.tables import saved

#: Registry status of a number by its ninth digit modulo 5; of the fifth kind there is no record.
_STATES = ["계속사업자", "휴업자", "폐업자", "국세청 미등록"]


def p7_telling_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.telling_columns(payments(spark, sf_dir), COLUMNS).select("_file", "column")


def p8_agency_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.agency_of_file(payments(spark, sf_dir))


def p9_program_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.program_names(payments(spark, sf_dir))


def c4_suspect_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered.suspect_unit(payments(spark, sf_dir), "지원금액", 20).select("_file", "_row", "value")


def c9_registry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = payments(spark, sf_dir)
    ninth = F.substring("b_no", 9, 1).cast("int") % 5
    book = df.select(N.digits(F.col("사업자번호")).alias("b_no")).where("length(b_no) = 10").distinct().where(ninth < 4)
    book = book.select("b_no", F.element_at(F.array(*map(F.lit, _STATES)), ninth + 1).alias("b_stt"), F.lit("19950101").alias("end_dt"))
    return registered.registry_status(df, "사업자번호", "지원일자", book).select("_file", "_row", "rule_id", "tier", "value")


def c16_numeric_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered.numeric_unit(payments(spark, sf_dir), "지원금액").select("_file", "_row", "value", "suggestion")


def g2_open_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = F.when(F.col("지원금액") == "", "").otherwise(F.concat(F.substring("지원금액", 1, 1), F.lit("0000")))
    df = payments(spark, sf_dir).withColumn("지원금액", coarse).withColumn("지원일자", F.when(F.col("_row") % 239 == 0, "내일").otherwise(F.col("지원일자")))
    found = groups.near_payments_open(df, ["사업명", "기관명"], 3)
    return found.select(F.col("사업명").alias("program"), F.col("기관명").alias("agency"), "n_rows", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "several_files")


def g5_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups.under_scopes(payments(spark, sf_dir), ["사업자번호"], {"per_business": 400_000, "total": 700_000, "per_payment": 300_000})
    return found.select("scope", F.col("사업자번호").alias("company"), F.col("사업명").alias("program"), "year", F.col("total").cast("long").alias("total"))


def _master(df: DataFrame) -> DataFrame:
    """A master table with missing and repeated codes; its rows are numbered from 2 on, as in a file."""
    n = F.substring("사업명", 1, 1).cast("int")
    return df.select("사업명").distinct().select((n + 1).alias("_row"), F.when(n % 2 == 1, "B1").alias("사업코드"), "사업명", F.lit("350000").alias("기업당한도"), n.cast("string").alias("연간허용횟수"), F.when(n % 2 == 0, "N").otherwise("Y").alias("시군내중복허용"))


def g6_master_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = payments(spark, sf_dir)
    found = groups.evaluated(df, groups.specs_from_master(_master(df)))
    of = lambda c: F.element_at(F.map_from_arrays("group_by", "key"), F.lit(c))
    return found.select("spec_id", of("사업자번호").alias("company"), of("기관명").alias("agency"), "year", "n_rows", F.coalesce(F.col("total").cast("long"), F.lit(-1)).alias("total"))


#: Rules of several key sets: different programs of a company in all years, a sum over two programs, and rows of a beneficiary and agency.
_SPECS = [("P", "MAX_COUNT", ["사업자번호"], "사업명", 3, None, "all", None), ("S", "SUM_LIMIT", ["기관명"], None, 3_000_000, "total", "year", ["1-URGENT", "2-HIGH"]), ("B", "SUM_LIMIT", ["수혜기업명"], None, 500_000, "per_business", "all", None), ("R", "MAX_COUNT", ["수혜기업명", "기관명"], None, 3, None, "year", None)]


def g6_any_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups.evaluated(payments(spark, sf_dir), spark.createDataFrame(_SPECS, groups.SPEC))
    return found.select("spec_id", F.concat_ws("|", "key").alias("key"), "year", "n", "n_rows", F.col("total").cast("long").alias("total"))


def g6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = payments(spark, sf_dir)
    specs = groups.specs_from_master(_master(df))
    return groups.spec_rows(df, specs, groups.evaluated(df, specs)).select("spec_id", "year", "_file", "_row")


def k4_masked_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("(주)"), "c_mktsegment")).otherwise(F.concat(F.col("c_mktsegment"), F.lit(" 주식회사")))
    return names.select("c_custkey", masking.company(name).alias("company"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the checks run once, whatever looks at their issues
    issues = saved(_issues(spark, sf_dir))
    return reports.cell_marks(reports.details(issues, decisions.system_decisions(issues), saved(decisions.changes(issues)), finalized=False))


def v1_cell_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("_file", "_row", "column", "status", "n")


def v4_ok_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = payments(spark, sf_dir)
    grouped = groups.payment_limit(df, 300_000)
    return reports.ok_rows(df, _marked(spark, sf_dir), grouped.limit(0), grouped).select("_file", "_row")


def _with_duplicates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Issues with those of r1's duplicate rows, and a log of decisions: an operator applies all of these, then rejects each third row's."""
    df = payments(spark, sf_dir).withColumn("지원일자", F.substring("지원일자", 1, 7))
    found = saved(cells.duplicate_issues(df, ["기관명", "사업명", "지원일자"]))
    issues = saved(_issues(spark, sf_dir))
    say = lambda rows, action, seq: rows.select("issue_id", F.lit(action).alias("action"), F.lit(None).cast("string").alias("value"), F.lit("operator").alias("decided_by"), F.lit(seq).alias("seq"))
    log = decisions.system_decisions(issues).withColumn("seq", F.lit(0)).unionByName(say(found, "apply", 1)).unionByName(say(found.where("_row % 3 = 0"), "reject", 2))
    return issues.unionByName(found), log


def d6_dropped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = decisions.changes(*_with_duplicates(spark, sf_dir))
    return decisions.cleaned(payments(spark, sf_dir), changed, COLUMNS).select("_file", "_row", F.col("사업자번호").alias("company"), F.col("지원금액").alias("amount"))


def v4_ok_without_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = payments(spark, sf_dir)
    issues, log = _with_duplicates(spark, sf_dir)
    changed = saved(decisions.changes(issues, log))
    marks = reports.cell_marks(reports.details(issues, log, changed, finalized=False))
    return reports.ok_rows(df, marks, reports.deleted_rows(changed), groups.payment_limit(df, 300_000)).select("_file", "_row")


def v6_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, log = _with_duplicates(spark, sf_dir)
    changed = saved(decisions.changes(issues, log))
    marks = reports.cell_marks(reports.details(issues, log, changed, finalized=False))
    return reports.file_status_counts(marks, reports.deleted_rows(changed)).select("_file", "approval", "request", "rejected", "auto", "deleted")


def d9_to_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = saved(_issues(spark, sf_dir))
    return decisions.to_ask(decisions.scoped(issues, ["DATE", "BIZNO"]), decisions.system_decisions(issues), issues).select("_file", "_row", "column", "rule_id")


def x7_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.file_summary(payments(spark, sf_dir), "지원금액").select("_file", "n_rows", F.col("total").cast("long").alias("total"))


def queries() -> dict:
    all_ = (p7_telling_columns, p8_agency_of_file, p9_program_names, c4_suspect_unit, c9_registry_status, c16_numeric_unit, g2_open_payments, g5_scopes, g6_master_rules, g6_any_rules, g6_rows, k4_masked_company, v1_cell_marks, v4_ok_rows, d6_dropped_rows, v4_ok_without_dropped, v6_file_status, d9_to_ask, x7_file_summary)
    return {f.__name__: f for f in all_}


_RIGHT = """length(dg) = 10 AND (10 - (CAST(dg[1] AS INT) + 3 * CAST(dg[2] AS INT) + 7 * CAST(dg[3] AS INT) + CAST(dg[4] AS INT) + 3 * CAST(dg[5] AS INT) + 7 * CAST(dg[6] AS INT) + CAST(dg[7] AS INT)
  + 3 * CAST(dg[8] AS INT) + 5 * CAST(dg[9] AS INT) + 5 * CAST(dg[9] AS INT) // 10) % 10) % 10 = CAST(dg[10] AS INT)"""
_MARKS = (
    _ISSUES
    + """, marks AS (SELECT _file, _row, "column", count(*) AS n, min(CASE tier WHEN 'approval' THEN 1 WHEN 'request' THEN 3 ELSE 6 END) AS p FROM found GROUP BY ALL)
"""
)
#: The rules of _master(), a number for each row, and the groups that break them.
_MASTER = (
    _PAY
    + """, a AS (SELECT _file, _row, company, "사업명" AS program, "기관명" AS ag, year, CAST(substr("사업명", 1, 1) AS INT) AS c, CASE WHEN "지원금액" = '0만' THEN 0 ELSE true_amount END AS x FROM keys),
broken AS (SELECT 'RS-000' || c || 'A' AS spec_id, company, NULL AS agency, year, count(*) AS n_rows, CAST(coalesce(sum(x), -1) AS BIGINT) AS total FROM a GROUP BY c, company, year HAVING count(*) > c
UNION ALL SELECT 'RS-000' || c || 'B', company, ag, year, count(*), CAST(coalesce(sum(x), -1) AS BIGINT) FROM a WHERE c % 2 = 0 GROUP BY c, company, ag, year HAVING count(*) > 1
UNION ALL SELECT 'RS-000' || c || 'C', company, NULL, year, count(*), CAST(sum(x) AS BIGINT) FROM a GROUP BY c, company, year HAVING sum(x) > 350000)
"""
)
#: r1's duplicate rows.
_LATER = """, r AS (SELECT _row, row_number() OVER (PARTITION BY "기관명", "사업명", substr("지원일자", 1, 7) ORDER BY _file, _row) AS n FROM keys), later AS (SELECT _row FROM r WHERE n > 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_telling_columns": _PAY
        + """, cells AS (UNPIVOT (SELECT _file, "기관명", "사업명", "수혜기업명", "사업자번호", "지원일자", "지원금액" FROM pay) ON "기관명", "사업명", "수혜기업명", "사업자번호", "지원일자", "지원금액" INTO NAME "column" VALUE value)
SELECT _file, "column" FROM cells WHERE trim(value) <> '' GROUP BY ALL HAVING min(value) < max(value) AND 2 * count(*) FILTER (regexp_full_match(replace(value, ',', ''), '[0-9０-９]+')) < count(*)""",
        "p8_agency_of_file": _PAY + """, n AS (SELECT _file, "기관명" AS agency, count(*) AS n FROM pay GROUP BY ALL) SELECT _file, arg_min(agency, (-n, agency)) AS agency FROM n GROUP BY _file""",
        "p9_program_names": _PAY + """SELECT DISTINCT trim("사업명") AS program FROM pay""",
        "c4_suspect_unit": _PAY
        + """, x AS (SELECT _file, _row, "지원금액" AS value, CASE WHEN "지원금액" = '0만' THEN 0 ELSE true_amount END AS x FROM keys), m AS (SELECT _file, median(x) AS m FROM x WHERE x IS NOT NULL GROUP BY _file HAVING count(*) >= 3)
SELECT x._file AS _file, _row, value FROM x JOIN m ON x._file = m._file WHERE x > 0 AND CAST(x AS VARCHAR) = value AND m >= 20 * x""",
        "c9_registry_status": _PAY
        + f""", v AS (SELECT _file, _row, "사업자번호" AS value, CAST(dg[9] AS INT) % 5 AS s, o6 = 0 AND true_day > '1995-01-01' AS late FROM keys WHERE {_RIGHT})
SELECT _file, _row, CASE WHEN s = 1 THEN 'BIZNO_SUSPENDED' WHEN s = 2 AND late THEN 'BIZNO_CLOSED_BEFORE_SUPPORT' WHEN s = 2 THEN 'BIZNO_CLOSED_AFTER_SUPPORT' WHEN s = 3 THEN 'BIZNO_NOT_FOUND' ELSE 'BIZNO_UNVERIFIED' END AS rule_id,
  CASE WHEN s = 3 OR s = 2 AND late THEN 'request' ELSE 'approval' END AS tier, value FROM v WHERE s > 0""",
        "c16_numeric_unit": _PAY
        + """SELECT _file, _row, "지원금액" AS value, regexp_replace("지원금액", '[,만원]', '', 'g') AS suggestion FROM keys WHERE regexp_matches("지원금액", '[,만원]')""",
        "g2_open_payments": f"""WITH RECURSIVE pay AS ({_DUCK_VIEW}),
r AS (SELECT _row AS id, _file, "사업명" AS program, "기관명" AS agency, CASE WHEN _row % 239 <> 0 THEN CAST(true_day AS DATE) END AS day, CASE WHEN "지원금액" <> '' THEN translate(substr("지원금액", 1, 1), '０１２３４５６７８９', '0123456789') END AS amount FROM pay),
e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.program = b.program AND a.agency = b.agency AND a.id <> b.id AND coalesce(abs(date_diff('day', a.day, b.day)) <= 3, TRUE) AND coalesce(a.amount = b.amount, TRUE)),
reach(id, other) AS (SELECT id, id FROM r UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a), c AS (SELECT id, min(other) AS label FROM reach GROUP BY id)
SELECT program, agency, count(*) AS n_rows, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, min(_file) <> max(_file) AS several_files FROM r JOIN c ON r.id = c.id GROUP BY label, program, agency HAVING count(*) > 1""",
        "g5_scopes": _PAY
        + """, a AS (SELECT company, "사업명" AS program, year, CASE WHEN "지원금액" = '0만' THEN 0 ELSE true_amount END AS x FROM keys)
SELECT 'per_business' AS scope, company, program, year, CAST(sum(x) AS BIGINT) AS total FROM a GROUP BY company, program, year HAVING sum(x) > 400000
UNION ALL SELECT 'total', company, NULL, year, CAST(sum(x) AS BIGINT) FROM a GROUP BY company, year HAVING sum(x) > 700000 UNION ALL SELECT 'per_payment', company, program, year, x FROM a WHERE x > 300000""",
        "g6_master_rules": _MASTER + "SELECT spec_id, company, agency, year, n_rows, total FROM broken",
        "g6_rows": _MASTER + """SELECT spec_id, a.year AS year, _file, _row FROM broken b JOIN a ON a.c = CAST(substr(spec_id, 4, 4) AS INT) AND a.company = b.company AND a.year = b.year AND (b.agency IS NULL OR b.agency = a.ag)""",
        "g6_any_rules": _PAY
        + """, a AS (SELECT company, "사업명" AS program, "기관명" AS ag, "수혜기업명" AS who, year, CASE WHEN "지원금액" = '0만' THEN 0 ELSE true_amount END AS x FROM keys)
SELECT 'P' AS spec_id, company AS key, NULL AS year, count(DISTINCT program) AS n, count(*) AS n_rows, CAST(sum(x) AS BIGINT) AS total FROM a GROUP BY company HAVING count(DISTINCT program) > 3
UNION ALL SELECT 'S', ag, year, count(*), count(*), CAST(sum(x) AS BIGINT) FROM a WHERE program IN ('1-URGENT', '2-HIGH') GROUP BY ag, year HAVING sum(x) > 3000000
UNION ALL SELECT 'B', who || '|' || program, NULL, count(*), count(*), CAST(sum(x) AS BIGINT) FROM a GROUP BY who, program HAVING sum(x) > 500000
UNION ALL SELECT 'R', who || '|' || ag, year, count(*), count(*), CAST(sum(x) AS BIGINT) FROM a GROUP BY who, ag, year HAVING count(*) > 3""",
        "k4_masked_company": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '(주)' || substr(c_mktsegment, 1, 1) || repeat('○', length(c_mktsegment) - 1) ELSE substr(c_mktsegment, 1, 1) || repeat('○', length(c_mktsegment) - 1) || ' 주식회사' END AS company FROM customer",
        "v1_cell_marks": _MARKS + """SELECT _file, _row, "column", CASE p WHEN 1 THEN 'approval' WHEN 3 THEN 'request' ELSE 'auto' END AS status, n FROM marks""",
        "v4_ok_rows": _MARKS + "SELECT _file, _row FROM keys WHERE _row NOT IN (SELECT _row FROM marks) AND NOT coalesce(true_amount > 300000, FALSE)",
        "d6_dropped_rows": _PAY + _LATER + """SELECT _file, _row, company, CASE WHEN "지원금액" = '0만' THEN '0' ELSE coalesce(CAST(true_amount AS VARCHAR), "지원금액") END AS amount FROM keys WHERE _row % 3 = 0 OR _row NOT IN (SELECT _row FROM later)""",
        "v4_ok_without_dropped": _MARKS + _LATER + "SELECT _file, _row FROM keys WHERE _row NOT IN (SELECT _row FROM marks) AND _row NOT IN (SELECT _row FROM later) AND NOT coalesce(true_amount > 300000, FALSE)",
        "v6_file_status": _ISSUES + _LATER + """, details AS (SELECT _file, _row, "column", CASE tier WHEN 'approval' THEN 1 WHEN 'request' THEN 3 ELSE 6 END AS p FROM found UNION ALL SELECT _file, k._row, '기관명', 4 FROM keys k JOIN later ON later._row = k._row WHERE k._row % 3 = 0),
m AS (SELECT _file, _row, "column", min(p) AS p FROM details GROUP BY ALL), g AS (SELECT _file, count(*) AS deleted FROM keys k JOIN later ON later._row = k._row WHERE k._row % 3 <> 0 GROUP BY 1)
SELECT m._file AS _file, count(*) FILTER (p = 1) AS approval, count(*) FILTER (p = 3) AS request, count(*) FILTER (p = 4) AS rejected, count(*) FILTER (p = 6) AS auto, coalesce(max(deleted), 0) AS deleted FROM m LEFT JOIN g ON g._file = m._file GROUP BY m._file""",
        "d9_to_ask": _ISSUES.replace("found AS (", "found AS MATERIALIZED (") + """SELECT _file, _row, "column", rule_id FROM found WHERE (rule_id LIKE 'DATE%' OR rule_id LIKE 'BIZNO%') AND (_row, "column") IN (SELECT _row, "column" FROM found WHERE tier = 'request')""",
        "x7_file_summary": _PAY + """SELECT _file, count(*) AS n_rows, coalesce(CAST(sum(CASE WHEN regexp_full_match("지원금액", '[0-9]+') THEN CAST("지원금액" AS BIGINT) END) AS BIGINT), 0) AS total FROM pay GROUP BY _file""",
    }
