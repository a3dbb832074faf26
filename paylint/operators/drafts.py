"""Requests to agencies: drafts for issues and for groups, cells that wait for an answer, notes, merged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylint.functions import masking

CELL = ["_file", "_sheet", "_row", "column"]
#: Texts of the exported tables and of drafts.
PENDING, NOTE, GROUP_SUFFIX = "(회신 대기)", "확인 요청", " (집계 확인)"
ROWS, TARGET, PLACE, ELSEWHERE = "행", "   - 대상: ", "   - 위치: ", "   - 같은 건이 다른 파일에도 걸쳐 있음: "
#: A part of a draft's body has the issues of so many rows of a sheet.
ROWS_A_PART = 1000


def _bodies(lines: DataFrame, joint: str) -> DataFrame:
    """(_file, part, n, total, issue_ids, body) from lines (_file, part, at, issue_id, line): a row for each part of a file's body.

    The parts of a file, joined in order, are its whole body.  A task has one part,
    however long the body is; only counts of parts meet by file.
    """
    parts = lines.groupBy("_file", "part").agg(F.array_sort(F.collect_list(F.struct("at", "issue_id", "line"))).alias("x")).select("_file", "part", F.size("x").cast("long").alias("n"), F.transform("x", lambda x: x["issue_id"]).alias("issue_ids"), F.array_join(F.transform("x", lambda x: x["line"]), joint).alias("body"))
    totals = lines.groupBy("_file").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("_file", "_of")
    return parts.join(totals, F.col("_file") == F.col("_of")).drop("_of")


def _addressed(bodies: DataFrame, recipients: DataFrame, org: Column, subject: Column) -> DataFrame:
    to = recipients.select(F.col("_file").alias("_to"), "mail")
    return bodies.join(to, F.col("_file") == F.col("_to"), "left").select(org.alias("org"), F.col("mail").alias("to"), subject.alias("subject"), F.col("total").alias("n"), "part", "issue_ids", "body")


def request_drafts(issues: DataFrame, recipients: DataFrame) -> DataFrame:
    """(org, to, subject, n, part, issue_ids, body): a draft for each file with a line for each of its issues, all of them.

    issues: (_file, _row, column, rule_id, message, issue_id), masked before.  recipients: (_file, mail).
    n counts the issues of the file.  A body comes in parts, by rows of the sheet, with
    the issues of its lines in their order; parts are to be joined by line ends.
    """
    line = F.concat(F.lit("- "), F.col("_row").cast("string"), F.lit(ROWS + " "), F.col("column"), F.lit(": "), F.col("message"))
    at = F.struct("_row", "column", "rule_id", F.col("issue_id").alias("id"))
    lines = issues.select("_file", F.floor(F.col("_row") / ROWS_A_PART).cast("string").alias("part"), at.alias("at"), "issue_id", line.alias("line"))
    found = _bodies(lines.withColumn("part", F.lpad("part", 12, "0")), "\n")
    return _addressed(found, recipients, F.col("_file"), F.concat(F.lit("[데이터 보완 요청] "), "_file"))


def _numbered(df: DataFrame, key: str, bucket: Column, order: list[str]) -> DataFrame:
    """df with part (its bucket) and _at, its place from 1 among all rows of its key in the order of bucket and `order`.

    Rows are put in order bucket by bucket; the counts of the buckets say where each begins.
    """
    split = df.withColumn("part", bucket)
    counts = split.groupBy(key, "part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(key).alias("_key"), F.col("part").alias("_part"), (F.sum("_n").over(Window.partitionBy(key).orderBy("part")) - F.col("_n")).alias("_before"))
    placed = split.withColumn("_in", F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)))
    return placed.join(before, (F.col(key) == F.col("_key")) & (F.col("part") == F.col("_part"))).withColumn("_at", F.col("_before") + F.col("_in")).drop("_key", "_part", "_before", "_in")


def group_request_drafts(cells: DataFrame, ok: DataFrame, recipients: DataFrame) -> DataFrame:
    """(org, to, subject, n, part, issue_ids, body): groups that are not marked ok, sent to every file they touch.

    cells: (group_id, rule_id, metric, key, _file, _sheet, _row), key the masked text
    of the group's key.  ok: (group_id).  A line says where the group is in the file
    and in which other files it is; lines are numbered within the file.  Bodies come
    in parts as in request_drafts(), with the groups as their issues.
    """
    rows = cells.join(ok.select("group_id").distinct(), "group_id", "left_anti").select("group_id", "rule_id", "metric", "key", "_file", "_sheet", "_row").distinct()
    by_sheet = rows.groupBy("group_id", "rule_id", "metric", "key", "_file", "_sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_row")), lambda x: x.cast("string")), ", ").alias("at"))
    where = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_sheet", "at"))), lambda x: F.concat(x["_sheet"], F.lit(" "), x["at"], F.lit(ROWS))), ", ")
    by_file = by_sheet.groupBy("group_id", "rule_id", "metric", "key", "_file").agg(where.alias("where"))
    files = by_file.groupBy("group_id").agg(F.array_sort(F.collect_list("_file")).alias("files"))
    others = by_file.join(files, "group_id").withColumn("others", F.array_remove("files", F.col("_file")))
    # a bucket is a rule and the first two digits of its groups' identifiers, which are hashes
    placed = _numbered(others, "_file", F.concat_ws("|", "rule_id", F.substring("group_id", 1, 2)), ["rule_id", "group_id"])
    also = F.when(F.size("others") > 0, F.concat(F.lit("\n" + ELSEWHERE), F.array_join("others", ", "))).otherwise("")
    line = F.concat(F.col("_at").cast("string"), F.lit(". "), "rule_id", F.lit(" — "), "metric", F.lit("\n" + TARGET), "key", F.lit("\n" + PLACE), "_file", F.lit(" "), "where", also)
    found = _bodies(placed.select("_file", "part", F.col("_at").alias("at"), F.col("group_id").alias("issue_id"), line.alias("line")), "\n")
    subject = F.concat(F.lit("[확인 요청] "), "_file", F.lit(" — 집계 점검 "), F.col("total").cast("string"), F.lit("건"))
    return _addressed(found, recipients, F.concat("_file", F.lit(GROUP_SUFFIX)), subject)


def key_text(columns: dict[str, Column], number: str = "사업자번호") -> Column:
    """``name: value`` of a group's key, joined by `` / ``; the business number is masked."""
    return F.concat_ws(" / ", *(F.concat(F.lit(f"{n}: "), F.coalesce((masking.business_number(c) if n == number else c).cast("string"), F.lit(""))) for n, c in columns.items()))


def pending_overlay(df: DataFrame, issues: DataFrame, handled: DataFrame, columns: list[str]) -> DataFrame:
    """df with the cells whose request was handled as PENDING; issues: (cell, issue_id), handled: (_file) of drafts that were sent or stored."""
    cells = issues.join(handled.select("_file").distinct(), "_file", "left_semi").where(F.col("column").isin(columns)).select(*CELL).distinct()
    by_row = cells.groupBy("_file", "_sheet", "_row").agg(F.collect_set("column").alias("_waiting"))
    joined = df.join(by_row, ["_file", "_sheet", "_row"], "left")
    waits = lambda c: F.coalesce(F.array_contains("_waiting", c), F.lit(False))
    return joined.select(*(F.when(waits(c), PENDING).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def noted(df: DataFrame, cells: DataFrame, handled: DataFrame) -> DataFrame:
    """df with the column NOTE: for each row of a file whose group draft was handled, the groups it is in and where they are.

    cells: (group_id, rule_id, _file, _sheet, _row).  Notes of a row are ordered and
    joined by line ends; rows without any have null.
    """
    by_file = cells.select("group_id", "rule_id", "_file", "_row").distinct().groupBy("group_id", "rule_id", "_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_row")), lambda x: x.cast("string")), "·").alias("at"))
    short = F.split_part(F.regexp_replace("_file", "[.][^.]*$", ""), F.lit("_"), F.lit(1))
    text = by_file.groupBy("group_id", "rule_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(short, F.lit(" "), "at", F.lit(ROWS)))), " / ").alias("where"))
    rows = cells.join(handled.select("_file").distinct(), "_file", "left_semi").select("group_id", "_file", "_sheet", "_row").distinct()
    notes = rows.join(text, "group_id").groupBy("_file", "_sheet", "_row").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit(PENDING + " "), "rule_id", F.lit(" — "), "where"))), "\n").alias(NOTE))
    return df.join(notes, ["_file", "_sheet", "_row"], "left")


def merged(parts: list[DataFrame]) -> DataFrame:
    """All parts in one table: columns by name in the order in which they first come, the notes last, null where a part lacks one."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    names = [c for c in out.columns if c != NOTE] + [c for c in out.columns if c == NOTE]
    return out.select(*(F.col(f"`{c}`") for c in names))
