"""Registered queries of documents put together again, published runs and masked findings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylint.functions import masking
from paylint.operators import decisions, pages
from paylint.plans.exports import _HIDDEN, CELL, _json_folder, _read
from paylint.plans.registry import _ISSUES, _issues
from paylint.sources import json_arrays, json_documents, publication, tables

#: The folder of a file, which tells the files of _json_folder() apart.
_FOLDER = "regexp_extract(_metadata.file_path, '([^/]+)/[^/]+$', 1)"


def s6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each nation as one JSON document with other keys, nested objects and lists; some numbers change, some records go, and the documents are written and read again."""
    c = _read(spark, sf_dir, "customer").join(F.broadcast(_read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    item = F.struct("c_custkey", F.struct(F.floor(F.col("c_acctbal") * 100).alias("balance"), F.array(F.lit("a"), F.col("c_mktsegment")).alias("tags")).alias("money"), F.col("c_name").alias("name"))
    docs = c.groupBy(F.col("n_nationkey").alias("part"), "n_name").agg(F.array_sort(F.collect_list(item)).alias("customers"))
    value = F.to_json(F.struct(F.struct("n_name", F.col("part").alias("key")).alias("nation"), "customers", F.array(F.lit(1), F.lit(2)).alias("codes")))
    paths = [_json_folder(spark, docs.select("part", value.alias("value")))]
    _, records = json_documents.documents(spark, paths, _FOLDER)
    key = F.get_json_object("text", "$.c_custkey").cast("long")
    cell = ["_file", "_sheet", "_row"]
    edits = records.where(key % 3 == 0).select(*cell, F.lit("money.balance").alias("column"), (key * 2).cast("string").alias("after"), F.lit(1).alias("step"))
    drops = records.where(key % 7 == 0).select(*cell, F.lit("name").alias("column"), F.lit(None).cast("string").alias("after"), F.lit(1).alias("step"))
    json_documents.write(json_documents.rebuilt(spark, paths, edits.unionByName(drops), name=_FOLDER), out := tables.new_path(spark, "documents"))
    back = spark.read.text(out, wholetext=True).select(F.from_json("value", "nation struct<n_name: string, key: int>, customers array<struct<c_custkey: long, money: struct<balance: long, tags: array<string>>, name: string>>, codes array<int>").alias("d"))
    rows = back.select("d.nation.n_name", F.size("d.codes").alias("n_codes"), F.posexplode("d.customers").alias("place", "c"))
    return rows.select("n_name", "n_codes", "place", "c.c_custkey", "c.money.balance", F.col("c.money.tags")[1].alias("segment"), "c.name")


def s10_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see of three runs: the first is published, the second broke off, the third was tried twice and published once."""
    store, issues = tables.new_path(spark, "runs"), tables.saved(_issues(spark, sf_dir).select("issue_id", *CELL, "rule_id", "tier", F.coalesce("value", F.lit("")).alias("value")))
    for run_id, kept, done in (("r1", "tier = 'auto'", True), ("r2", "true", False), ("r3", "true", False), ("r3", "tier = 'request'", True)):
        run = publication.Run(spark, store, run_id)
        run.write("issues", issues.where(kept))
        if done:
            run.write("reports", decisions.summary(issues.where(kept)))
            run.commit()
    seen = publication.runs(spark, store).select("run_id").collect()
    out = None
    for r in seen:
        rows = publication.loaded_issues(spark, store, r["run_id"]).groupBy("run_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"))
        out = rows if out is None else out.unionByName(rows)
    return out


def k6_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.concat("rule_id", F.lit(": "), "value", F.lit(" -> "), F.coalesce("suggestion", F.lit("?")))
    return masking.findings(_issues(spark, sf_dir).withColumn("message", told)).select("_file", "_row", "column", "rule_id", "value", "suggestion", "message")


def s2_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each region as one file that is a list, with brackets, quotes and escapes in texts, read in pieces."""
    c = _read(spark, sf_dir, "customer").join(F.broadcast(_read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat("c_name", F.element_at(F.array(*map(F.lit, _NASTY)), (F.col("c_custkey") % len(_NASTY) + 1).cast("int")))
    docs = c.groupBy(F.col("n_regionkey").alias("part")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("c_custkey", F.struct(text.alias("text"), F.array(F.struct("c_mktsegment")).alias("l")).alias("o"))))).alias("value"))
    got = json_arrays.load_json_array(spark, [_json_folder(spark, docs)], _FOLDER)
    return got.select(F.regexp_extract("_file", "[0-9]+", 0).cast("long").alias("region"), "_row", F.try_variant_get("record", "$.c_custkey", "long").alias("c_custkey"), F.try_variant_get("record", "$.o.text", "string").alias("text"), F.try_variant_get("record", "$.o.l[0].c_mktsegment", "string").alias("segment"))


#: Ends of texts that look like the end of a record.
_NASTY = ['"}', "\\", "}, {", "]", '\\"}', ""]


def m5_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighth page of a hundred of the issues that are not automatic, from the index of their ranges."""
    order = ["_file", "_row", "column", "rule_id"]
    issues = _issues(spark, sf_dir).where("tier <> 'auto'").select("_file", "_row", "column", "rule_id", "tier")
    pages.write_pages(issues, path := tables.new_path(spark, "pages"), order, 1_000)
    return pages.Pages(spark, path, order).page(7, 100)


def queries() -> dict:
    return {f.__name__: f for f in (s6_documents, s10_published, k6_findings, s2_json_array, m5_deep_page)}


def oracle_sql() -> dict[str, str]:
    hide = lambda c: f"CASE WHEN \"column\" = '사업자번호' THEN {_HIDDEN.format(c)} ELSE {c} END"
    return {
        "s6_documents": """SELECT n_name, 2 AS n_codes, CAST(row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) - 1 AS INTEGER) AS place, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2 ELSE CAST(floor(c_acctbal * 100) AS BIGINT) END AS balance,
  c_mktsegment AS segment, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0""",
        "s2_json_array": "SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) + 1 AS _row, c_custkey, c_name || [" + ", ".join(f"'{x}'" for x in _NASTY) + f"][c_custkey % {len(_NASTY)} + 1] AS text, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey",
        "m5_deep_page": _ISSUES + """, f AS (SELECT _file, _row, "column", rule_id, tier, row_number() OVER (ORDER BY _file, _row, "column", rule_id) - 1 AS place FROM found WHERE tier <> 'auto') SELECT * FROM f WHERE place BETWEEN 700 AND 799""",
        "s10_published": _ISSUES + """SELECT 'r1' AS run_id, rule_id, count(*) AS n, count(nullif(value, '')) AS n_values FROM found WHERE tier = 'auto' GROUP BY rule_id UNION ALL SELECT 'r3', rule_id, count(*), count(nullif(value, '')) FROM found WHERE tier = 'request' GROUP BY rule_id""",
        "k6_findings": _ISSUES + f"""SELECT _file, _row, "column", rule_id, {hide('value')} AS value, {hide('suggestion')} AS suggestion, rule_id || ': ' || {hide('value')} || ' -> ' || coalesce({hide('suggestion')}, '?') AS message FROM found""",
    }
