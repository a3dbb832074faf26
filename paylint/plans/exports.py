"""Registered queries of sources, lists, drafts, groups' rows and the remaining checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylint.functions import masking
from paylint.functions import normalize as N
from paylint.operators import cells, decisions, drafts, fuzzy, groups, profiles, registered, reports, strict
from paylint.plans.registry import _DUCK_VIEW, _ISSUES, _PAY, COLUMNS, _issues, payments
from paylint.plans.review import _LATER, _with_duplicates
from paylint.sources import tables

CELL = ["_file", "_sheet", "_row", "column"]
ROW = ["_file", "_sheet", "_row"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sources ---


def s1_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV and loaded; in_place: rows are numbered from 2 without gaps in each file."""
    path = tables.new_path(spark, "csv")
    _read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("c_mktsegment")).write.csv(path, header=True)
    df = tables.saved(tables.load_csv(spark, [path], "customers"))
    files = df.groupBy("_file").agg((F.min("_row") == 2) & (F.max("_row") == F.count(F.lit(1)) + 1) & (F.count_distinct("_row") == F.count(F.lit(1))))
    return df.join(files.toDF("_f", "in_place"), F.col("_file") == F.col("_f")).select("_sheet", "c_custkey", "c_name", "c_mktsegment", "in_place")


def s1_parquet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load_parquet(spark, [f"{sf_dir}/nation.parquet", f"{sf_dir}/nation.parquet"][:1], "nations").select("_sheet", "_row", "n_nationkey", "n_name")


def _json_folder(spark: SparkSession, docs: DataFrame) -> str:
    """A file for each row of docs (part, value)."""
    path = tables.new_path(spark, "json")
    docs.repartition("part").write.partitionBy("part").text(path)
    return path


def _json_files(spark: SparkSession, docs: DataFrame) -> str:
    """A file for each row of docs (part, value) in one folder, written and committed by many tasks.

    Without a number of partitions small rows all meet in one task, and a folder for
    each file has to be made, moved and listed too.
    """
    path = tables.new_path(spark, "json")
    spread = docs.repartition(4 * spark.sparkContext.defaultParallelism, "part").select("value")
    spread.write.options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(path)
    return path


def s2_json_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each hundred as one file with two lists, one with nested objects."""
    c = _read(spark, sf_dir, "customer").withColumn("part", F.floor(F.col("c_custkey") / 100))
    item = F.struct("c_custkey", F.struct("c_name", F.col("c_mktsegment").alias("segment")).alias("of"))
    docs = c.groupBy("part").agg(F.array_sort(F.collect_list(item)).alias("all"))
    docs = docs.select("part", F.to_json(F.struct(F.col("all").alias("customers"), F.slice("all", 1, 2).alias("first"), F.lit(1).alias("n"))).alias("value"))
    got = tables.load_json(spark, [_json_files(spark, docs)])
    return got.select("_sheet", "_row", F.try_variant_get("record", "$.c_custkey", "long").alias("c_custkey"), F.try_variant_get("record", "$.of.segment", "string").alias("segment"))


_SHAPES = ['{"a":[{"x":1}],"b":[],"c":[1,2],"d":{"y":1}}', "[]", "[1,2]", '"text"', '[{"x":1}]', "not json"]


def s3_unsupported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 50).alias("part")).distinct()
    docs = c.select("part", F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("part") % len(_SHAPES) + 1).cast("int")).alias("value"))
    return tables.unsupported_json(spark, [_json_files(spark, docs)]).groupBy("key", "reason").agg(F.count(F.lit(1)).alias("n"))


def s4_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.struct("o_custkey", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderstatus")).alias("status")).alias("by"), F.array("o_orderpriority").alias("tags")).alias("of"))
    return tables.as_text(o).select("o_orderkey", F.col("`of.by.o_custkey`").alias("custkey"), F.col("`of.by.status`").alias("status"), F.col("`of.tags`").alias("tags"))


def s6_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned orders as JSON in the types they were read in; rows with an empty amount are dropped, each third name is changed."""
    p = payments(spark, sf_dir)
    original = p.select(*ROW, F.col("true_amount").alias("amount"), F.col("수혜기업명").alias("name"), F.col("사업자번호").alias("number"))
    cleaned = original.where("amount is not null").select(*ROW, F.col("amount").cast("string").alias("amount"), F.when(F.col("_row") % 3 == 0, F.lit('say "x"')).otherwise(F.col("name")).alias("name"), "number")
    return tables.json_records(original, cleaned).select("_file", "_row", "record")


def s7_written_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.new_path(spark, "cleaned")
    tables.write_cleaned(payments(spark, sf_dir).select(*ROW, *COLUMNS), path)
    back = spark.read.parquet(path)
    return back.groupBy("_file", "_sheet").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_row").alias("n_places"), F.min("사업자번호").alias("least"))


def s11_masked_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues masked, written for two runs and loaded for one (S8, S11, K5, K6)."""
    path = tables.new_path(spark, "issues")
    masked = masking.issues(_issues(spark, sf_dir)).select("issue_id", *CELL, "rule_id", "tier", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("suggestion", F.lit("")).alias("suggestion"))
    tables.write_run(masked, path, "run-1")
    tables.write_run(masked.where("tier = 'auto'"), path, "run-2")
    return tables.load_issues(spark, path, "run-1").select("_file", "_row", "column", "rule_id", "value", "suggestion")


def s12_next_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned rows of the second of two runs."""
    path = tables.new_path(spark, "cleaned")
    p = payments(spark, sf_dir).select(*ROW, F.col("사업명").alias("program"))
    tables.write_run(p, path, "a")
    tables.write_run(p.where("_row % 2 = 0"), path, "b")
    return tables.cleaned_of_run(spark, path, "b").select("_file", "_row", "program")


def s10_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each month of orders; the latest five."""
    path = tables.new_path(spark, "reports")
    months = _read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
    months.write.partitionBy("run_id").parquet(path)
    return tables.runs(spark, path, 5).select(F.col("run_id").cast("string").alias("run_id"))


def s13_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies as groups, orders as the log of what was said of them."""
    log = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("group_id"), F.col("o_orderstatus").alias("disposition"), F.col("o_orderkey").alias("seq"))
    return tables.last_dispositions(log)


def s14_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.new_path(spark, "codes")
    _read(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_brand", F.when(F.col("p_partkey") % 2 == 0, "  ").otherwise("")).alias("code"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).alias("name")).write.csv(path, header=True)
    return tables.codebook(spark, path)


def s15_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address for each supplier's nation, the last well-formed one of one file."""
    path = tables.new_path(spark, "contacts")
    s = _read(spark, sf_dir, "supplier")
    mail = F.when(F.col("s_suppkey") % 4 == 0, F.lit("none at all")).otherwise(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@mail.kr ")))
    s.orderBy("s_suppkey").coalesce(1).select(F.col("s_nationkey").cast("string").alias("기관명"), F.lit("부서").alias("담당부서"), mail.alias("담당자메일")).write.csv(path, header=True)
    return tables.contacts(spark, path)


# --- profiles ---


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agency as a file; which columns it has follows from its payments."""
    p = payments(spark, sf_dir)
    return p.select(F.col("기관명").alias("file"), F.lit("실적").alias("sheet"), F.explode(F.array(*(F.when((F.col("_row") % 5 != i) | (F.length("기관명") > 6), F.lit(c)) for i, c in enumerate(COLUMNS)))).alias("column"), (F.length("기관명") % 3).alias("_l")).where("column is not null and not (_l = 2 and column in ('기관명', '사업명'))").drop("_l").distinct()


def _standards(spark: SparkSession) -> DataFrame:
    rows = [("실적", 0, c) for c in COLUMNS] + [("요약", 1, c) for c in ("사업명", "지원금액", "지원건수")]
    return spark.createDataFrame(rows, "standard string, ord int, column string")


def p1_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.match_standard(_catalog(spark, sf_dir), _standards(spark)).select("file", "standard")


def p2_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    definitions = spark.createDataFrame([("실적", "지원금액", "amount", True, {"unit": "원"}), ("실적", "지원일자", "date", True, {"range": "2026"}), ("실적", "사업자번호", "biz_no", False, None)], "standard string, column string, kind string, required boolean, params map<string,string>")
    found = profiles.profile_columns(profiles.match_standard(catalog, _standards(spark)), catalog, definitions)
    return found.select("file", "column", "kind", "required", F.coalesce(F.element_at("params", F.lit("unit")), F.lit("")).alias("unit"))


# --- cells ---


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a sheet with phones, names and notes of all kinds; some rows are blank."""
    c = _read(spark, sf_dir, "customer")
    d = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    kind = F.col("c_custkey") % 6
    phone = F.when(kind == 0, F.concat(F.lit("0"), d)).when(kind == 1, F.concat(F.lit("01"), d)).when(kind == 2, F.concat(F.lit("010-"), F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 4))).when(kind == 3, F.substring(d, 1, 7)).when(kind == 4, F.concat(F.lit("0"), F.substring(d, 1, 2), F.lit(" "), F.substring(d, 3, 7))).otherwise("")
    name = F.when(kind == 0, F.concat(F.lit("㈜"), "c_mktsegment")).when(kind == 1, F.concat(F.lit("  "), "c_mktsegment", F.lit("  A"))).when(kind == 2, F.translate("c_mktsegment", "ABCDE", "ＡＢＣＤＥ")).otherwise(F.col("c_mktsegment"))
    note = F.when(kind == 0, F.lit("tab\there")).when(kind == 1, F.lit("n/a")).when(kind == 2, F.lit("　wide　")).when(kind == 3, F.lit("NaN ")).when(kind == 4, F.lit("two  gaps")).otherwise("fine")
    blank = F.col("c_custkey") % 41 == 0
    cell = lambda x: F.when(blank, F.lit(" - ")).otherwise(x)
    return c.select(F.concat(F.lit("f"), (F.col("c_custkey") % 3).cast("string"), F.lit("_x.csv")).alias("_file"), F.lit("s").alias("_sheet"), (F.col("c_custkey") + 2).alias("_row"), cell(phone).alias("phone"), cell(name).alias("name"), cell(note).alias("note"))


def c1_blank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _people(spark, sf_dir)
    df = cells.parsed(df, blanks=["phone", "name", "note"])
    return cells.collected(df, cells.blank(df, ["phone", "name", "note"], ["phone", "note"])).select("_file", "_row", "column", "tier", "value", "suggestion")


def c18_phones_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _people(spark, sf_dir)
    return cells.collected(df, [*cells.phone("phone"), *cells.text("name")]).select("_file", "_row", "rule_id", "tier", "value", "suggestion")


def c11_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.collected(_people(spark, sf_dir), strict.required(["phone", "note"])).select("_file", "_row", "column", "rule_id", "tier", "value")


def c12_iso_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.collected(payments(spark, sf_dir), strict.iso_date_range("지원일자", "1993-06-01", "1995-06-30")).select("_file", "_row", "rule_id", "tier", "value")


_SCHEMA = {"type": "object", "required": ["k", "kind"], "properties": {"k": {"type": "integer", "minimum": 5, "maximum": 90}, "kind": {"type": "string", "enum": ["view", "click", "buy"], "pattern": "^[a-z]+$"}}}


def c20_json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    props = F.when(F.col("event_id") % 50 == 0, F.lit("{bad")).when(F.col("event_id") % 50 == 1, F.lit("[1]")).when(F.col("event_id") % 50 == 2, F.lit(" ")).when(F.col("event_id") % 50 == 3, F.lit('{"k":"x","kind":"view"}')).when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.regexp_replace("props", "}$", ""), F.lit(',"kind":"'), "event_type", F.lit('"}')))
    df = e.select(F.lit("events").alias("_file"), F.lit("s").alias("_sheet"), F.col("event_id").alias("_row"), props.alias("props"))
    return strict.json_schema(df, "props", _SCHEMA).select("_row", "rule_id", "tier", "value", "message")


def c10_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status record for each order of a company; hours are order days, so that some are too old."""
    o = _read(spark, sf_dir, "orders")
    at = F.expr("timestamp'2026-03-05 12:00:00' + make_interval(0, 0, 0, 0, date_diff(cast(o_orderdate as date), date'1998-08-02')) + make_dt_interval(0, 0, 0, o_orderkey / 1000000)")
    raw = o.select(F.concat(F.lit("1"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.when(F.col("o_custkey") % 9 == 0, "").otherwise("7")).alias("b_no"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderstatus")).alias("b_stt"), F.when(F.col("o_orderkey") % 6 == 0, "국세청에 등록되지 않은 사업자").otherwise("일반").alias("tax_type"), F.col("o_orderkey").cast("string").alias("end_dt"), at.alias("_ts"))
    return registered.snapshot(raw, "2026-03-05 12:00:00", 24 * 30).select("b_no", "b_stt", "end_dt")


# --- rows and groups ---


def r2_near_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a sheet, compared within a brand; their names differ in a number."""
    p = _read(spark, sf_dir, "part")
    df = p.select(F.lit("parts").alias("_file"), F.lit("s").alias("_sheet"), F.col("p_partkey").alias("_row"), F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 7).cast("string")).alias("name"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("size"), "p_brand")
    return fuzzy.near_duplicate_rows(df, ["name", "size"], 0.9, ["p_brand"]).select("_file", "_row", "like_row", F.round("score", 6).alias("score"))


def c15_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with a letter too many, and the three names nearest to them."""
    p = _read(spark, sf_dir, "part")
    codes = p.groupBy(F.col("p_name").alias("code")).agg(F.min("p_partkey").alias("ord"))
    df = p.select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.substring("p_brand", -1, 1))).alias("name"))
    return fuzzy.nearest_codes(df, "name", codes).select("value", "rank", "code", F.round("score", 6).alias("score"))


def r3_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail against a summary that is wrong for one program, lacks one and has one too many."""
    p = payments(spark, sf_dir)
    s = p.groupBy("사업명").agg(F.count(F.lit(1)).alias("n"), F.sum(N.amount(F.col("지원금액"))).alias("total")).where("`사업명` not like '2%'")
    s = s.select("사업명", F.col("n").cast("string").alias("지원건수"), F.when(F.col("사업명").startswith("3"), F.col("total") + 1).otherwise(F.col("total")).cast("string").alias("지원금액합계"))
    s = s.unionByName(s.limit(1).select(F.lit("없는 사업").alias("사업명"), F.lit("1").alias("지원건수"), F.lit("5").alias("지원금액합계")))
    out = groups.reconcile(p, s, "사업명", "지원건수", "지원금액합계")
    return out.select(F.col("사업명").alias("program"), "n", F.col("n_summary").cast("long").alias("n_summary"), F.col("sum").cast("long").alias("sum"), F.col("sum_summary").cast("long").alias("sum_summary"))


def r4_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments(spark, sf_dir).groupBy("_file").agg(groups.excluded(payments(spark, sf_dir)).alias("n"))


def _g1_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payments(spark, sf_dir)
    keys = ["사업자번호", "사업명"]
    return tables.saved(groups.group_cells(p, groups.max_count(p, keys), keys, "MAX_COUNT", F.concat(F.col("n").cast("string"), F.lit("건"))))


def g1_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _g1_cells(spark, sf_dir).select("rule_id", "metric", "key", "_file", "_row")


def g2_tolerant_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of one agency and program within 20 days and 5 percent; 1 in 239 has no readable day."""
    df = payments(spark, sf_dir).withColumn("지원일자", F.when(F.col("_row") % 239 == 0, "내일").otherwise(F.col("지원일자")))
    found = groups.near_payments_open(df, ["사업명", "기관명"], 20, tol_pct=5.0)
    return found.select(F.col("사업명").alias("program"), F.col("기관명").alias("agency"), "n_rows", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "several_files")


def g2_near_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of chains of payments of a company, its amounts cut to one digit."""
    df = payments(spark, sf_dir).withColumn("지원금액", F.when(F.col("지원금액") == "", "").otherwise(F.concat(F.substring("지원금액", 1, 1), F.lit("0000"))))
    return groups.near_payment_rows(df, ["사업자번호"], ["사업자번호", "사업명"], 30).select("kind", "n_rows", "_file", "_row")


def v3_group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _g1_cells(spark, sf_dir)
    said = found.where("substr(metric, 1, 1) = '3'").select("group_id", F.lit("ok").alias("disposition")).distinct()
    return reports.group_rows(found, said).select("_file", "_row", "rule_id", "metric", "disposition")


def v5_sheet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _g1_cells(spark, sf_dir)
    said = found.where("substr(metric, 1, 1) = '3'").select("group_id", F.lit("ok").alias("disposition")).distinct()
    return reports.sheet_checks(payments(spark, sf_dir), ["MAX_COUNT", "SUM_LIMIT"], reports.group_rows(found, said)).select("_file", "rule_id", "n", "ok", "request")


# --- decisions and marks ---


def _two_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of dates by both lists of layouts: those that differ suggest two values for a cell."""
    df = cells.parsed(payments(spark, sf_dir), ["지원금액"], ["지원일자"])
    return cells.collected(df, [*cells.amount("지원금액"), *cells.date("지원일자"), cells.issue("지원일자", "DATE_YEAR", "auto", F.col("_row") % 4 == 0, suggestion=N.year(F.col("지원일자")))])


def d1_escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.escalated(_two_suggestions(spark, sf_dir)).select("_file", "_row", "column", "rule_id", "tier")


def d2_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.scoped(_issues(spark, sf_dir), ["AMOUNT", "BLANK"]).groupBy("rule_id", "tier").agg(F.count(F.lit(1)).alias("n"))


def d5_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the system and of operators on all issues, some of no issue: only BIZNO and duplicates are in scope."""
    issues, log = _with_duplicates(spark, sf_dir)
    log = log.withColumn("decided_by", F.when(F.col("seq") == 1, "system").otherwise(F.col("decided_by")))
    log = log.unionByName(log.where("seq = 2").withColumn("issue_id", F.lit("unknown")))
    return decisions.guarded(log, issues, ["BIZNO", "DUPLICATE"]).groupBy("action", "decided_by", "seq").agg(F.count(F.lit(1)).alias("n"))


def d4_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.approved_decisions(_issues(spark, sf_dir)).groupBy("action", "decided_by").agg(F.count(F.lit(1)).alias("n"))


def d6_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a cell with two suggestions, in the order of the checks."""
    issues = _two_suggestions(spark, sf_dir).where("`column` = '지원일자'")
    return decisions.changes(issues, decisions.system_decisions(issues)).select("_file", "_row", "rule_id", "before", "after", "step")


def d6_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of amounts with white space around some: operators edit the blanks of each second such cell, and the amount is then read from what they typed."""
    df = payments(spark, sf_dir).withColumn("지원금액", F.when(F.col("_row") % 3 == 0, F.concat(F.lit("  "), "지원금액", F.lit(" "))).otherwise(F.col("지원금액")))
    df = cells.parsed(df, ["지원금액"], blanks=COLUMNS)
    issues = cells.collected(df, [*cells.blank(df, COLUMNS, ["지원금액"]), *cells.amount("지원금액", df)])
    blanks = issues.where("rule_id = 'BLANK' and tier = 'auto' and _row % 2 = 0").select("issue_id", F.lit("edit").alias("action"), F.lit("9,999").alias("value"), F.lit("operator").alias("decided_by"))
    log = decisions.system_decisions(issues).withColumn("seq", F.lit(0)).unionByName(blanks.withColumn("seq", F.lit(1)))
    return decisions.changes(issues, log).select("_file", "_row", "rule_id", "before", "after", "decided_by", "step")


def d8_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks still find when all automatic fixes are in; nothing automatic is left."""
    issues = _issues(spark, sf_dir)
    p = payments(spark, sf_dir)
    rows = tables.saved(decisions.cleaned(p, decisions.changes(issues), COLUMNS))

    def again(df: DataFrame) -> DataFrame:
        period = ("1993-01-01", "1996-12-31")
        df = cells.parsed(df, ["지원금액"], ["지원일자"], periods={"지원일자": period}, blanks=COLUMNS, numbers=["사업자번호"])
        return cells.collected(df, [*cells.blank(df, COLUMNS, COLUMNS), *cells.amount("지원금액", df), *cells.date("지원일자", *period, df), *cells.business_number("사업자번호", df)])

    return decisions.rechecked(again, rows)[0].select("_file", "_row", "column", "rule_id", "tier", "value")


def d10_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether results are stale after nothing, after decisions of the system, and after one more of an operator."""
    _, log = _with_duplicates(spark, sf_dir)
    before = decisions.fingerprint(log)
    system = log.unionByName(log.where("decided_by = 'system'").withColumn("seq", F.lit(9)))
    one = log.unionByName(log.where("decided_by = 'operator'").orderBy("issue_id").limit(1).withColumn("action", F.lit("edit")))
    out = None
    for name, now in (("same", log), ("system", system), ("operator", one)):
        part = before.crossJoin(decisions.fingerprint(now).withColumnRenamed("basis", "now")).select(F.lit(name).alias("after"), (F.col("basis") != F.col("now")).alias("stale"))
        out = part if out is None else out.union(part)
    return out


def d11_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.bulk_duplicates(_with_duplicates(spark, sf_dir)[0]).select("_file", "_row", "value")


def m1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decisions.report(_issues(spark, sf_dir))
    return r.select(F.array_join(F.transform(F.map_entries("by_rule_id"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("rules"), F.array_join(F.transform(F.map_entries("by_tier"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("tiers"), F.col("total").cast("long").alias("total"), "passed")


def m5_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page(_issues(spark, sf_dir), ["approval", "request"], ["BIZNO_CHECKSUM", "DATE_NORMALIZE"], 1, 50).select("_file", "_row", "column", "rule_id")


def _details(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    issues, log = _with_duplicates(spark, sf_dir)
    changed = tables.saved(decisions.changes(issues, log))
    return reports.details(issues, log, changed, finalized=True), reports.deleted_rows(changed)


def v2_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _details(spark, sf_dir)[1].select("_file", "_row")


def v7_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.change_list(*_details(spark, sf_dir), json_rows=True).select("_file", "place", "part", F.coalesce("column", F.lit("")).alias("column"), "status", "rule_id")


def v8_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, gone = _details(spark, sf_dir)
    p = payments(spark, sf_dir)
    return reports.visible_rows(p, reports.cell_marks(found), gone, groups.payment_limit(p, 300_000), hide_auto=True, number=1, rows=40).select("_file", "_row")


def v9_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pending(_details(spark, sf_dir)[0]).select("_file", "_row", "column", "rule_id", "before")


# --- drafts ---


def _recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "region").where("r_name != 'AFRICA'").select(F.col("r_name").alias("_file"), F.concat(F.lower("r_name"), F.lit("@mail.kr")).alias("mail"))


def x1_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of all issues of business numbers, every line of every part; bodies and the issues in them are compared by their hashes."""
    asked = masking.issues(_issues(spark, sf_dir).where("rule_id like 'BIZNO%'")).withColumn("message", F.concat("rule_id", F.lit(" "), "value"))
    out = drafts.request_drafts(asked, _recipients(spark, sf_dir))
    return out.select("org", F.coalesce("to", F.lit("-")).alias("to"), "subject", "n", F.col("part").cast("long").alias("part"), F.size("issue_ids").cast("long").alias("n_issues"), F.md5("body").alias("body"))


def x2_group_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _g1_cells(spark, sf_dir)
    out = drafts.group_request_drafts(found, found.where("substr(metric, 1, 1) = '3'").select("group_id"), _recipients(spark, sf_dir))
    return out.select("org", F.coalesce("to", F.lit("-")).alias("to"), "subject", "n", "part", F.md5(F.array_join("issue_ids", ",")).alias("groups"), F.md5("body").alias("body"))


def x3_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as drafts, orders as the log of sending."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("org"), F.concat(F.lit("c"), (F.col("c_custkey") % 7).cast("string")).alias("to"), F.lit("s").alias("subject"))
    log = _read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "실제").otherwise("시험").alias("mode"), F.col("o_custkey").cast("string").alias("org"), F.concat(F.lit("c"), (F.col("o_custkey") % 7 + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).cast("string")).alias("to"), F.when(F.col("o_orderkey") % 11 < 9, "s").otherwise("other").alias("subject"), F.when(F.col("o_orderkey") % 3 == 0, "성공").when(F.col("o_orderkey") % 3 == 1, "저장만 됨").otherwise("실패").alias("result"))
    return reports.outbox(c, log).select("org", "handled", "sent", "status")


def x4_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payments(spark, sf_dir)
    handled = _recipients(spark, sf_dir).select("_file")
    out = drafts.pending_overlay(p, _issues(spark, sf_dir).where("rule_id in ('BIZNO_FORMAT', 'BLANK')"), handled, COLUMNS)
    return out.select("_file", "_row", F.col("사업자번호").alias("number"), F.col("지원금액").alias("amount"), F.col("사업명").alias("program"))


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.noted(payments(spark, sf_dir).select(*ROW, "사업명"), _g1_cells(spark, sf_dir), _recipients(spark, sf_dir).select("_file"))


def x5_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noted(spark, sf_dir).where(f"`{drafts.NOTE}` is not null").select("_file", "_row", F.md5(drafts.NOTE).alias("note"))


def x6_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables with different columns as one: notes go last, the place of each column among the others is told."""
    noted = _noted(spark, sf_dir)
    more = payments(spark, sf_dir).where("_row % 10 = 0").select(*ROW, "기관명")
    out = drafts.merged([noted.where("_row % 10 = 1"), more, noted.where("_row % 10 = 2").select(*ROW, "사업명")])
    return out.select("_file", "_row", F.col("사업명").alias("program"), F.col("기관명").alias("agency"), F.col(drafts.NOTE).isNotNull().alias("noted"), F.lit(",".join(out.columns[3:])).alias("columns"))


def k2_masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payments(spark, sf_dir)
    text = F.concat(F.lit("번호 "), "사업자번호", F.when(F.col("_row") % 2 == 0, "1").otherwise(" 입니다"))
    return p.select("_file", "_row", masking.in_text(text).alias("text"), masking.cell(F.lit("사업자번호"), F.col("사업자번호")).alias("number"), masking.cell(F.lit("비고"), F.col("사업자번호")).alias("other"))


def queries() -> dict:
    names = (s1_csv_rows, s1_parquet_rows, s2_json_tables, s3_unsupported_json, s4_flattened, s6_json_records, s7_written_tables, s10_runs, s11_masked_log, s12_next_input, s13_dispositions, s14_codebook, s15_contacts, p1_matched, p2_profiles, c1_blank_cells, c10_snapshot, c11_required, c12_iso_range, c15_nearest, c18_phones_texts, c20_json_schema, r2_near_rows, r3_reconciled, r4_excluded, g1_group_rows, g2_tolerant_payments, g2_near_rows, v3_group_labels, v5_sheet_checks, d1_escalated, d2_scoped, d4_batch, d5_guarded, d6_chained, d6_edited, d8_remaining, d10_stale, d11_bulk, m1_report, m5_page, v2_deleted, v7_changes, v8_page, v9_pending, x1_drafts, x2_group_drafts, x3_outbox, x4_waiting, x5_notes, x6_merged, k2_masked_texts)
    return {f.__name__: f for f in names}


_DG = "regexp_replace({0}, '[^0-9]', '', 'g')"
#: A business number as it is masked in a cell: ten digits, or nine.
_HIDDEN = f"CASE WHEN length({_DG}) = 10 THEN substr({_DG}, 1, 3) || '-' || substr({_DG}, 4, 2) || '-*****' ELSE substr({_DG}, 1, 3) || '-' || substr({_DG}, 4, 2) || '-' || repeat('*', length({_DG}) - 5) END"
_MASK = "CASE WHEN length(dg) = 10 THEN substr(dg, 1, 3) || '-' || substr(dg, 4, 2) || '-*****' ELSE k.company END"
_GROUPS = (
    _PAY
    + f""", gr AS (SELECT company, "사업명" AS program, year, count(*) AS n FROM keys GROUP BY ALL HAVING count(*) > 1),
gc AS (SELECT k._file AS _file, k._sheet AS _sheet, k._row AS _row, n, n || '건' AS metric, '사업자번호: ' || {_MASK} || ' / 사업명: ' || program || ' / year: ' || gr.year AS key, hash(gr.company, program, gr.year) AS g
  FROM keys k JOIN gr ON gr.company = k.company AND gr.program = k."사업명" AND gr.year = k.year)
"""
)
_PEOPLE = """WITH raw AS (SELECT *, lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS d, c_custkey % 6 AS k, c_custkey % 41 = 0 AS none, c_mktsegment AS m, 'f' || (c_custkey % 3) || '_x.csv' AS _file, c_custkey + 2 AS _row FROM customer),
people AS (SELECT *, CASE WHEN none THEN ' - ' WHEN k = 0 THEN '0' || d WHEN k = 1 THEN '01' || d WHEN k = 2 THEN '010-' || substr(d, 1, 4) || '-' || substr(d, 5, 4) WHEN k = 3 THEN substr(d, 1, 7) WHEN k = 4 THEN '0' || substr(d, 1, 2) || ' ' || substr(d, 3, 7) ELSE '' END AS phone,
  CASE WHEN none THEN ' - ' WHEN k = 0 THEN '㈜' || m WHEN k = 1 THEN '  ' || m || '  A' WHEN k = 2 THEN translate(m, 'ABCDE', 'ＡＢＣＤＥ') ELSE m END AS name,
  CASE WHEN none THEN ' - ' WHEN k = 0 THEN 'tab' || chr(9) || 'here' WHEN k = 1 THEN 'n/a' WHEN k = 2 THEN '　wide　' WHEN k = 3 THEN 'NaN ' WHEN k = 4 THEN 'two  gaps' ELSE 'fine' END AS note FROM raw)
"""
_TWO = (
    _PAY
    + """, dn AS (SELECT *, o6 <> 0 AS changed, o6 = 5 AND CAST(substr(true_day, 9, 2) AS INT) <= 12 AS unsure, _row % 4 = 0 AS by_year FROM keys)
"""
)
#: Components of payments: r has id, _file, g, day, amount and what else a query wants; e the pairs that fit.
_REACH = """, reach(id, other) AS (SELECT id, id FROM r UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a), comp AS (SELECT id, min(other) AS label FROM reach GROUP BY id)
"""
_DETAILS = (
    _ISSUES
    + _LATER
    + """, details AS (SELECT _file, _row, "column", CASE tier WHEN 'auto' THEN 'auto' WHEN 'request' THEN 'request' ELSE 'undecided' END AS status, rule_id, value FROM found
  UNION ALL SELECT _file, k._row, '기관명', 'rejected', 'DUPLICATE_ROW', NULL FROM keys k JOIN later ON later._row = k._row WHERE k._row % 3 = 0),
gone AS (SELECT _file, k._row AS _row FROM keys k JOIN later ON later._row = k._row WHERE k._row % 3 <> 0)
"""
)


def oracle_sql() -> dict[str, str]:
    """SQL of all but nearest codes and near rows, whose measure is a longest common subsequence; these are tested by brute force."""
    return {
        "s1_csv_rows": "SELECT 'customers' AS _sheet, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment ELSE '' END AS c_mktsegment, TRUE AS in_place FROM customer",
        "s1_parquet_rows": "SELECT 'nations' AS _sheet, CAST(n_nationkey + 2 AS BIGINT) AS _row, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation",
        "s2_json_tables": """WITH c AS (SELECT c_custkey, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS n FROM customer)
SELECT 'customers' AS _sheet, n + 1 AS _row, c_custkey, segment FROM c UNION ALL SELECT 'first', n + 1, c_custkey, segment FROM c WHERE n <= 2""",
        "s3_unsupported_json": """WITH p AS (SELECT DISTINCT c_custkey // 50 % 6 AS s, c_custkey // 50 AS part FROM customer),
u(s, key, reason) AS (VALUES (0, 'b', 'empty list'), (0, 'c', 'list of other things than objects'), (1, '(file)', 'empty list'), (2, '(file)', 'list of other things than objects'), (3, '(file)', 'neither list nor object'), (5, '(file)', 'not JSON'))
SELECT key, reason, count(*) AS n FROM p JOIN u USING (s) GROUP BY ALL""",
        "s4_flattened": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS custkey, CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus ELSE '' END AS status, '["' || o_orderpriority || '"]' AS tags FROM orders""",
        "s6_json_records": _PAY + """SELECT _file, _row, '{"amount":' || true_amount || ',"name":"' || CASE WHEN _row % 3 = 0 THEN 'say \\"x\\"' ELSE "수혜기업명" END || '","number":"' || "사업자번호" || '"}' AS record FROM keys WHERE true_amount IS NOT NULL""",
        "s7_written_tables": _PAY + """SELECT _file, _sheet, count(*) AS n_rows, count(DISTINCT _row) AS n_places, min("사업자번호") AS least FROM pay GROUP BY ALL""",
        "s10_runs": "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS run_id FROM orders ORDER BY run_id DESC LIMIT 5",
        "s11_masked_log": _ISSUES + f"""SELECT _file, _row, "column", rule_id, CASE WHEN "column" = '사업자번호' THEN {_HIDDEN.format('value')} ELSE nullif(value, '') END AS value, CASE WHEN "column" = '사업자번호' THEN {_HIDDEN.format('suggestion')} ELSE suggestion END AS suggestion FROM found""",
        "s12_next_input": _PAY + """SELECT _file, _row, "사업명" AS program FROM pay WHERE _row % 2 = 0""",
        "s13_dispositions": "SELECT CAST(o_custkey AS VARCHAR) AS group_id, arg_max(o_orderstatus, o_orderkey) AS disposition FROM orders GROUP BY o_custkey",
        "s14_codebook": "SELECT DISTINCT p_brand AS code FROM part",
        "s15_contacts": "SELECT CAST(s_nationkey AS VARCHAR) AS agency, 's' || max(s_suppkey) || '@mail.kr' AS mail FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY s_nationkey",
        "p1_matched": _PAY + """SELECT DISTINCT "기관명" AS file, '실적' AS standard FROM pay WHERE length("기관명") % 3 <> 2""",
        "p2_profiles": _PAY
        + """, f AS (SELECT DISTINCT "기관명" AS file, length("기관명") % 3 <> 2 AS whole FROM pay), c(c) AS (VALUES ('기관명'), ('사업명'), ('수혜기업명'), ('사업자번호'), ('지원일자'), ('지원금액'))
SELECT file, c AS "column", CASE WHEN NOT whole THEN 'unknown' WHEN c = '지원금액' THEN 'amount' WHEN c = '지원일자' THEN 'date' WHEN c = '사업자번호' THEN 'biz_no' ELSE 'unknown' END AS kind,
  whole AND c IN ('지원금액', '지원일자') AS required, CASE WHEN whole AND c = '지원금액' THEN '원' ELSE '' END AS unit FROM f, c WHERE whole OR c NOT IN ('기관명', '사업명')""",
        "c1_blank_cells": _PEOPLE
        + """SELECT _file, _row, 'phone' AS "column", 'auto' AS tier, '(빈 행)' AS value, NULL AS suggestion FROM people WHERE none
UNION ALL SELECT _file, _row, 'phone', 'request', phone, NULL FROM people WHERE NOT none AND k = 5 UNION ALL SELECT _file, _row, 'note', 'request', note, NULL FROM people WHERE NOT none AND k IN (1, 3)
UNION ALL SELECT _file, _row, 'name', 'auto', name, m || ' A' FROM people WHERE NOT none AND k = 1
UNION ALL SELECT _file, _row, 'note', 'auto', note, CASE k WHEN 0 THEN 'tab here' WHEN 2 THEN 'wide' ELSE 'two gaps' END FROM people WHERE NOT none AND k IN (0, 2, 4)""",
        "c18_phones_texts": _PEOPLE
        + """, dg AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS g FROM people)
SELECT _file, _row, 'PHONE_FORMAT' AS rule_id, CASE WHEN k = 3 THEN 'approval' ELSE 'auto' END AS tier, phone AS value, CASE k WHEN 1 THEN substr(g, 1, 3) || '-' || substr(g, 4, 4) || '-' || substr(g, 8) WHEN 3 THEN NULL ELSE substr(g, 1, 3) || '-' || substr(g, 4, 3) || '-' || substr(g, 7) END AS suggestion FROM dg WHERE NOT none AND k IN (0, 1, 3, 4)
UNION ALL SELECT _file, _row, 'TEXT_NORMALIZE', 'auto', name, CASE WHEN none THEN '-' WHEN k = 0 THEN '(주)' || m WHEN k = 1 THEN m || ' A' ELSE m END FROM people WHERE none OR k IN (0, 1, 2)""",
        "c11_required": _PEOPLE + """SELECT _file, _row, 'phone' AS "column", 'REQUIRED' AS rule_id, 'request' AS tier, '(공백)' AS value FROM people WHERE phone = '' UNION ALL SELECT _file, _row, 'note', 'REQUIRED', 'request', '(공백)' FROM people WHERE note = 'NaN '""",
        "c12_iso_range": _PAY + """SELECT _file, _row, 'DATE_RANGE' AS rule_id, 'request' AS tier, "지원일자" AS value FROM keys WHERE o6 IN (0, 2) AND true_day NOT BETWEEN '1993-06-01' AND '1995-06-30'""",
        "c20_json_schema": """WITH e AS (SELECT event_id AS _row, event_id % 50 AS m, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, event_type AS t, props AS p FROM events),
v AS (SELECT *, CASE WHEN m = 0 THEN '{bad' WHEN m = 1 THEN '[1]' WHEN m = 2 THEN ' ' WHEN m = 3 THEN '{"k":"x","kind":"view"}' WHEN _row % 3 = 0 THEN p ELSE substr(p, 1, length(p) - 1) || ',"kind":"' || t || '"}' END AS value,
  CASE WHEN m = 0 THEN 'not JSON' WHEN m = 1 THEN '$: not object' WHEN m = 2 THEN NULL WHEN m = 3 THEN '$[''k'']: not integer' WHEN _row % 3 = 0 THEN '$: kind is missing' WHEN k < 5 THEN '$[''k'']: below minimum' WHEN k > 90 THEN '$[''k'']: above maximum' WHEN t NOT IN ('view', 'click', 'buy') THEN '$[''kind'']: not in enum' END AS message FROM e)
SELECT _row, 'JSON_SCHEMA' AS rule_id, 'approval' AS tier, value, message FROM v WHERE message IS NOT NULL""",
        "c10_snapshot": """WITH r AS (SELECT *, date_diff('day', DATE '1998-08-02', CAST(o_orderdate AS DATE)) AS h FROM orders WHERE o_custkey % 9 <> 0),
l AS (SELECT o_custkey, arg_max(o_orderkey, (h, o_orderkey)) AS o FROM r WHERE h > -720 OR (h = -720 AND o_orderkey > 0) GROUP BY 1)
SELECT '1' || lpad(CAST(l.o_custkey AS VARCHAR), 8, '0') || '7' AS b_no, CASE WHEN o % 6 = 0 THEN '국세청 미등록' WHEN o % 3 = 0 THEN ' ' ELSE o_orderstatus END AS b_stt, CAST(o AS VARCHAR) AS end_dt FROM l JOIN orders ON o_orderkey = o""",
        "r3_reconciled": _PAY
        + """, p AS (SELECT "사업명" AS program, count(*) AS n, CAST(sum(true_amount) AS BIGINT) AS s FROM keys GROUP BY 1)
SELECT program, n, CASE WHEN program LIKE '3%' THEN n END AS n_summary, s AS sum, CASE WHEN program LIKE '3%' THEN s + 1 END AS sum_summary FROM p WHERE program LIKE '2%' OR program LIKE '3%' UNION ALL SELECT '없는 사업', NULL, 1, NULL, 5""",
        "r4_excluded": _PAY + "SELECT _file, count(*) FILTER (length(dg) <> 10) AS n FROM keys GROUP BY _file",
        "g1_group_rows": _GROUPS + "SELECT 'MAX_COUNT' AS rule_id, metric, key, _file, _row FROM gc",
        "g2_tolerant_payments": f"""WITH RECURSIVE pay AS ({_DUCK_VIEW}),
r AS (SELECT _row AS id, _file, "사업명" AS program, "기관명" AS agency, CASE WHEN _row % 239 <> 0 THEN CAST(true_day AS DATE) END AS day, CASE WHEN "지원금액" = '0만' THEN 0 ELSE true_amount END AS amount FROM pay),
e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.program = b.program AND a.agency = b.agency AND a.id <> b.id AND coalesce(abs(date_diff('day', a.day, b.day)) <= 20, TRUE)
  AND coalesce(CASE WHEN a.amount = 0 OR b.amount = 0 THEN a.amount = b.amount ELSE abs(a.amount - b.amount) * 100 <= 5 * greatest(a.amount, b.amount) END, TRUE)){_REACH}
SELECT program, agency, count(*) AS n_rows, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, min(_file) <> max(_file) AS several_files FROM r JOIN comp ON r.id = comp.id GROUP BY label, program, agency HAVING count(*) > 1""",
        "g2_near_rows": f"""WITH RECURSIVE pay AS ({_DUCK_VIEW}),
r AS (SELECT _row AS id, _file, "사업자번호" AS num, "사업명" AS program, regexp_replace("사업자번호", '[^0-9]', '', 'g') AS g, CAST(true_day AS DATE) AS day, CASE WHEN "지원금액" <> '' THEN translate(substr("지원금액", 1, 1), '０１２３４５６７８９', '0123456789') END AS amount FROM pay),
e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.g = b.g AND a.id <> b.id AND abs(date_diff('day', a.day, b.day)) <= 30 AND coalesce(a.amount = b.amount, TRUE)){_REACH},
w AS (SELECT r.*, label, count(*) OVER (PARTITION BY label) AS n, count(*) OVER (PARTITION BY label, num, program) AS same FROM r JOIN comp ON r.id = comp.id),
k AS (SELECT label, CASE WHEN min(_file) <> max(_file) THEN 'several_files' WHEN min(same) > 1 THEN 'same_rows' ELSE 'double' END AS kind FROM w GROUP BY label)
SELECT kind, n AS n_rows, _file, id AS _row FROM w JOIN k ON w.label = k.label WHERE n > 1""",
        "v3_group_labels": _GROUPS + "SELECT _file, _row, 'MAX_COUNT' AS rule_id, metric, CASE WHEN substr(metric, 1, 1) = '3' THEN 'ok' ELSE 'request' END AS disposition FROM gc",
        "v5_sheet_checks": _GROUPS
        + """, t AS (SELECT DISTINCT _file, g, substr(metric, 1, 1) = '3' AS fine FROM gc)
SELECT f._file AS _file, 'MAX_COUNT' AS rule_id, count(g) AS n, count(*) FILTER (fine) AS ok, count(*) FILTER (NOT fine) AS request FROM (SELECT DISTINCT _file FROM pay) f LEFT JOIN t ON t._file = f._file GROUP BY f._file
UNION ALL SELECT DISTINCT _file, 'SUM_LIMIT', 0, 0, 0 FROM pay""",
        "d1_escalated": _TWO
        + """SELECT _file, _row, '지원금액' AS "column", 'AMOUNT_NORMALIZE' AS rule_id, 'auto' AS tier FROM dn WHERE "지원금액" <> '' AND CASE WHEN "지원금액" = '0만' THEN '0' ELSE CAST(true_amount AS VARCHAR) END <> "지원금액"
UNION ALL SELECT _file, _row, '지원일자', 'DATE_NORMALIZE', CASE WHEN unsure AND by_year THEN 'request' WHEN unsure OR by_year THEN 'approval' ELSE 'auto' END FROM dn WHERE changed
UNION ALL SELECT _file, _row, '지원일자', 'DATE_YEAR', CASE WHEN changed THEN 'approval' ELSE 'auto' END FROM dn WHERE by_year""",
        "d2_scoped": _ISSUES + "SELECT rule_id, tier, count(*) AS n FROM found WHERE rule_id LIKE 'AMOUNT%' OR rule_id LIKE 'BLANK%' GROUP BY ALL",
        "d4_batch": _ISSUES + "SELECT CASE WHEN tier = 'request' THEN 'request' ELSE 'apply' END AS action, CASE WHEN tier = 'approval' THEN 'operator' ELSE 'system' END AS decided_by, count(*) AS n FROM found GROUP BY ALL",
        "d5_guarded": _ISSUES
        + _LATER
        + """SELECT CASE tier WHEN 'auto' THEN 'apply' ELSE 'request' END AS action, 'system' AS decided_by, 0 AS seq, count(*) AS n FROM found WHERE rule_id LIKE 'BIZNO%' AND tier <> 'approval' GROUP BY ALL
UNION ALL SELECT 'reject', 'operator', 2, count(*) FROM later WHERE _row % 3 = 0""",
        "d6_edited": _PAY
        + """, c AS (SELECT _file, _row, "지원금액" AS cell, _row % 3 = 0 AS spaced, _row % 2 = 0 AS edited, CASE WHEN "지원금액" = '0만' THEN '0' ELSE CAST(true_amount AS VARCHAR) END AS canonical FROM keys WHERE "지원금액" <> '')
SELECT _file, _row, 'BLANK' AS rule_id, '  ' || cell || ' ' AS before, CASE WHEN edited THEN '9,999' ELSE cell END AS after, CASE WHEN edited THEN 'operator' ELSE 'system' END AS decided_by, 1 AS step FROM c WHERE spaced
UNION ALL SELECT _file, _row, 'AMOUNT_NORMALIZE', CASE WHEN spaced AND edited THEN '9,999' ELSE cell END, CASE WHEN spaced AND edited THEN '9999' ELSE canonical END, 'system', CASE WHEN spaced THEN 2 ELSE 1 END FROM c WHERE canonical IS NOT NULL AND (spaced OR canonical <> cell)""",
        "d6_chained": _TWO
        + """SELECT _file, _row, 'DATE_NORMALIZE' AS rule_id, "지원일자" AS before, true_day AS after, 1 AS step FROM dn WHERE changed AND NOT unsure
UNION ALL SELECT _file, _row, 'DATE_YEAR', CASE WHEN changed AND NOT unsure THEN true_day ELSE "지원일자" END, y, CASE WHEN changed AND NOT unsure THEN 2 ELSE 1 END FROM dn WHERE by_year""",
        "d8_remaining": _ISSUES + f"""SELECT _file, _row, "column", rule_id, tier, CASE WHEN rule_id = 'BIZNO_CHECKSUM' THEN substr({_DG.format('value')}, 1, 3) || '-' || substr({_DG.format('value')}, 4, 2) || '-' || substr({_DG.format('value')}, 6) ELSE value END AS value FROM found WHERE tier <> 'auto'""",
        "d10_stale": "SELECT 'same' AS after, FALSE AS stale UNION ALL SELECT 'system', FALSE UNION ALL SELECT 'operator', count(*) > 0 FROM orders",
        "d11_bulk": _PAY
        + """, r AS (SELECT _file, _row, row_number() OVER w AS n, first_value(_file) OVER w AS first_file FROM keys WINDOW w AS (PARTITION BY "기관명", "사업명", substr("지원일자", 1, 7) ORDER BY _file, _row))
SELECT _file, _row, '(완전중복)' AS value FROM r WHERE n > 1 AND first_file = _file""",
        "m1_report": _ISSUES
        + """SELECT (SELECT string_agg(rule_id || '=' || n, ',' ORDER BY rule_id) FROM (SELECT rule_id, count(*) AS n FROM found GROUP BY 1)) AS rules, (SELECT string_agg(tier || '=' || n, ',' ORDER BY tier) FROM (SELECT tier, count(*) AS n FROM found GROUP BY 1)) AS tiers, count(*) AS total, count(*) = 0 AS passed FROM found""",
        "m5_page": _ISSUES + """SELECT _file, _row, "column", rule_id FROM found WHERE tier IN ('approval', 'request') AND rule_id IN ('BIZNO_CHECKSUM', 'DATE_NORMALIZE') ORDER BY _file, _row, "column", rule_id LIMIT 50 OFFSET 50""",
        "v2_deleted": _DETAILS + "SELECT _file, _row FROM gone",
        "v7_changes": _DETAILS + """SELECT _file, '[' || (_row - 2) || ']' AS place, 0 AS part, "column", status, rule_id FROM details UNION ALL SELECT _file, '[' || (_row - 2) || ']', 1, '', 'deleted', 'DUPLICATE_ROW' FROM gone""",
        "v8_page": _DETAILS + """SELECT _file, _row FROM keys WHERE true_amount > 300000 OR _row IN (SELECT _row FROM details WHERE status <> 'auto' UNION SELECT _row FROM gone) ORDER BY _file, _row LIMIT 40 OFFSET 40""",
        "v9_pending": _DETAILS + """SELECT _file, _row, "column", rule_id, value AS before FROM details WHERE status = 'request'""",
        "x1_drafts": _ISSUES
        + f""", b AS (SELECT _file, _row, '- ' || _row || '행 사업자번호: ' || rule_id || ' ' || {_HIDDEN.format('value')} AS line, rule_id, _row // 1000 AS part FROM found WHERE rule_id LIKE 'BIZNO%'),
t AS (SELECT _file, count(*) AS total FROM b GROUP BY 1)
SELECT b._file AS org, CASE WHEN b._file = 'AFRICA' THEN '-' ELSE lower(b._file) || '@mail.kr' END AS "to", '[데이터 보완 요청] ' || b._file AS subject, total AS n, CAST(part AS BIGINT) AS part, count(*) AS n_issues,
  md5(string_agg(line, chr(10) ORDER BY _row, rule_id)) AS body FROM b JOIN t ON t._file = b._file GROUP BY b._file, part, total""",
        "x2_group_drafts": _GROUPS
        + """, named AS (SELECT _file, _sheet, _row, n, metric, key, substr(sha256('MAX_COUNT|' || gr_company || '|' || gr_program || '|' || gr_year), 1, 16) AS gid FROM (SELECT gc.*, k.company AS gr_company, k."사업명" AS gr_program, k.year AS gr_year FROM gc JOIN keys k ON k._file = gc._file AND k._row = gc._row) WHERE n <> 3 AND substr(metric, 1, 1) <> '3'),
f AS (SELECT gid, metric, key, _file, string_agg(CAST(_row AS VARCHAR), ', ' ORDER BY _row) AS places FROM named GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY _file ORDER BY gid) AS place, count(*) OVER (PARTITION BY _file) AS total, array_to_string(list_filter(list_sort(list(_file) OVER (PARTITION BY gid)), lambda x: x <> _file), ', ') AS others FROM f),
l AS (SELECT *, place || '. MAX_COUNT — ' || metric || chr(10) || '   - 대상: ' || key || chr(10) || '   - 위치: ' || _file || ' 실적 ' || places || '행' || CASE WHEN others <> '' THEN chr(10) || '   - 같은 건이 다른 파일에도 걸쳐 있음: ' || others ELSE '' END AS line FROM o)
SELECT _file || ' (집계 확인)' AS org, CASE WHEN _file = 'AFRICA' THEN '-' ELSE lower(_file) || '@mail.kr' END AS "to", '[확인 요청] ' || _file || ' — 집계 점검 ' || total || '건' AS subject, total AS n, 'MAX_COUNT|' || substr(gid, 1, 2) AS part,
  md5(string_agg(gid, ',' ORDER BY place)) AS groups, md5(string_agg(line, chr(10) ORDER BY place)) AS body FROM l GROUP BY _file, total, substr(gid, 1, 2)""",
        "x3_outbox": """WITH c AS (SELECT *, CASE WHEN o_orderkey % 11 < 9 THEN 's' ELSE 'other' END AS subject, o_orderkey % 2 = 0 AS real, o_orderkey % 3 = 0 AS good, o_orderkey % 5 <> 0 AS same FROM orders)
SELECT CAST(c_custkey AS VARCHAR) AS org, EXISTS (SELECT 1 FROM c WHERE o_custkey = c_custkey AND o_orderkey % 3 < 2) AS handled, EXISTS (SELECT 1 FROM c WHERE o_custkey = c_custkey AND real AND good AND same AND subject = 's') AS sent,
  CASE WHEN EXISTS (SELECT 1 FROM c WHERE o_custkey = c_custkey AND real AND good AND subject = 's') THEN '발송됨' WHEN EXISTS (SELECT 1 FROM c WHERE o_custkey = c_custkey AND NOT real AND subject = 's') THEN '시험 저장' ELSE '초안' END AS status FROM customer""",
        "x4_waiting": _PAY + """SELECT _file, _row, CASE WHEN _file <> 'AFRICA' AND length(dg) <> 10 THEN '(회신 대기)' ELSE "사업자번호" END AS number, CASE WHEN _file <> 'AFRICA' AND "지원금액" = '' THEN '(회신 대기)' ELSE "지원금액" END AS amount, "사업명" AS program FROM keys""",
        "x5_notes": _GROUPS
        + """, pf AS (SELECT g, _file, _file || ' ' || string_agg(CAST(_row AS VARCHAR), '·' ORDER BY _row) || '행' AS p FROM gc GROUP BY g, _file), w AS (SELECT g, string_agg(p, ' / ' ORDER BY _file) AS w FROM pf GROUP BY g)
SELECT _file, _row, md5('(회신 대기) MAX_COUNT — ' || w) AS note FROM gc JOIN w ON w.g = gc.g WHERE _file <> 'AFRICA'""",
        "x6_merged": _GROUPS
        + """SELECT _file, _row, "사업명" AS program, NULL AS agency, _file <> 'AFRICA' AND _row IN (SELECT _row FROM gc) AS noted, '사업명,기관명,확인 요청' AS columns FROM pay WHERE _row % 10 = 1
UNION ALL SELECT _file, _row, NULL, "기관명", FALSE, '사업명,기관명,확인 요청' FROM pay WHERE _row % 10 = 0 UNION ALL SELECT _file, _row, "사업명", NULL, FALSE, '사업명,기관명,확인 요청' FROM pay WHERE _row % 10 = 2""",
        "k2_masked_texts": _PAY
        + f""", h AS (SELECT *, regexp_matches("사업자번호", '^[0-9]{{3}}-') AS dashed FROM keys)
SELECT _file, _row, '번호 ' || CASE WHEN dashed THEN substr(dg, 1, 3) || '-' || substr(dg, 4, 2) || '-*****' ELSE "사업자번호" || CASE WHEN _row % 2 = 0 THEN '1' ELSE '' END END || CASE WHEN _row % 2 = 0 THEN '' ELSE ' 입니다' END AS text, {_HIDDEN.format('"사업자번호"')} AS number, CASE WHEN dashed THEN substr(dg, 1, 3) || '-' || substr(dg, 4, 2) || '-*****' ELSE "사업자번호" END AS other FROM h""",
    }
