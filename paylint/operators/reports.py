"""Marks, lists and counts for those who look at a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylint.functions import normalize as N
from paylint.operators.decisions import last_decisions

CELL = ["_file", "_sheet", "_row", "column"]
#: Statuses of a cell, the one that wins first.
PRIORITY = ["approval", "undecided", "request", "rejected", "operator", "auto", "auto_pending"]


def details(issues: DataFrame, decisions: DataFrame, changes: DataFrame, finalized: bool, group_cells: DataFrame | None = None) -> DataFrame:
    """(cell, status, rule_id, before, after): one row for each change, each issue without a change, each cell of a group that is not in order."""
    made = changes.select(*CELL, F.when(F.col("decided_by") == "system", "auto").otherwise("operator").alias("status"), "rule_id", "before", "after").where("after is not null")
    rest = issues.join(changes.select("issue_id").distinct(), "issue_id", "left_anti").join(last_decisions(decisions).select("issue_id", "action"), "issue_id", "left")
    asked = (F.col("action") == "request") | (F.col("action").isNull() & (F.col("tier") == "request"))
    open_ = F.lit("undecided") if finalized else F.when(F.col("tier") == "auto", "auto_pending").when(F.col("tier") == "approval", "approval").otherwise("undecided")
    status = F.when(F.col("action") == "reject", "rejected").when(asked, "request").otherwise(open_)
    out = made.union(rest.select(*CELL, status, "rule_id", F.col("value"), F.when(status == "request", F.lit(None)).otherwise(F.col("suggestion"))))
    if group_cells is not None:
        none = F.lit(None).cast("string")
        out = out.union(group_cells.select(*CELL, F.lit("request"), "rule_id", none, none))
    return out


def cell_marks(found: DataFrame) -> DataFrame:
    """(cell, status, n): the status that wins among a cell's details."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("status"))
    return found.groupBy(*CELL).agg(F.min_by("status", rank).alias("status"), F.count(F.lit(1)).alias("n"))


def file_status_counts(marks: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """(_file, a column for each status): marks of each file; given deleted rows (deleted_rows()), also their number as `deleted`."""
    counts = marks.groupBy("_file").pivot("status", PRIORITY).count()
    if deleted is None:
        return counts.fillna(0)
    gone = deleted.groupBy("_file").agg(F.count(F.lit(1)).alias("deleted"))
    return counts.join(gone, "_file", "full").fillna(0)


def deleted_rows(changes: DataFrame) -> DataFrame:
    return changes.where("after is null").select("_file", "_sheet", "_row").distinct()


def ok_rows(df: DataFrame, marks: DataFrame, deleted: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows without a mark, not deleted and in no group."""
    row = ["_file", "_sheet", "_row"]
    seen = marks.select(*row).union(deleted.select(*row)).union(grouped.select(*row)).distinct()
    return df.select(*row).join(seen, row, "left_anti")


def pending(found: DataFrame) -> DataFrame:
    return found.where("status = 'request'")


#: How far a draft has come, by the log of sending.
SENT, STORED, DRAFT = "발송됨", "시험 저장", "초안"


def outbox(drafts: DataFrame, log: DataFrame) -> DataFrame:
    """drafts (org, to, subject) with handled, sent and status, from the log (mode, org, to, subject, result).

    handled: the agency's draft was sent or stored.  sent: this very one was really
    sent to this address, and must not be again.  status looks at agency and subject:
    SENT if one was really sent, else STORED if a trial was made, else DRAFT.  Null
    agencies and subjects are like none of the log.
    """
    really = (F.col("mode") == "실제") & (F.col("result") == "성공")
    handled = log.where(F.col("result").isin("성공", "저장만 됨")).select("org").distinct().withColumn("handled", F.lit(True))
    sent = log.where(really).select("org", "to", "subject").distinct().withColumn("sent", F.lit(True))
    come = log.groupBy("org", "subject").agg(F.max(F.when(really, 2).when(F.col("mode") == "시험", 1).otherwise(0)).alias("_come"))
    joined = drafts.join(handled, "org", "left").join(sent, ["org", "to", "subject"], "left").join(come, ["org", "subject"], "left")
    no = F.lit(False)
    status = F.when(F.col("_come") == 2, SENT).when(F.col("_come") == 1, STORED).otherwise(DRAFT)
    return joined.withColumns({"handled": F.coalesce("handled", no), "sent": F.coalesce("sent", no), "status": status}).select(*(F.col(f"`{c}`") for c in drafts.columns), "handled", "sent", "status")


def file_summary(df: DataFrame, c: str) -> DataFrame:
    """(_file, n_rows, total): rows and the sum of the whole amounts of a file."""
    whole = F.when(F.trim(f"`{c}`").rlike("^-?[0-9]+$"), F.trim(f"`{c}`").try_cast("decimal(20,0)"))
    return df.groupBy("_file").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(whole), F.lit(0)).alias("total"))


def page(issues: DataFrame, tiers: list[str], rules: list[str] | None = None, number: int = 0, rows: int = 50) -> DataFrame:
    kept = issues.where(F.col("tier").isin(tiers))
    kept = kept.where(F.col("rule_id").isin(rules)) if rules else kept
    return kept.orderBy("_file", "_sheet", "_row", "column", "rule_id", "issue_id").offset(number * rows).limit(rows)


def recipients(files: DataFrame, contacts: DataFrame) -> DataFrame:
    """files (_file, agency) with the mail of the agency, null if there is none."""
    return files.join(contacts, N.strip(F.col("agency")) == contacts["agency"], "left").select(files["_file"], files["agency"], "mail")


def group_rows(cells: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(_file, _sheet, _row, group_id, rule_id, metric, disposition) for each row of a group.

    cells: group cells (group_id, rule_id, metric, _file, _sheet, _row).  dispositions:
    (group_id, disposition), the last word on each; a group without one is a request.
    """
    said = dispositions.select(F.col("group_id").alias("_g"), F.col("disposition").alias("_said"))
    joined = cells.join(said, F.col("group_id") == F.col("_g"), "left")
    return joined.select("_file", "_sheet", "_row", "group_id", "rule_id", "metric", F.coalesce("_said", F.lit("request")).alias("disposition")).distinct()


def sheet_checks(sheets: DataFrame, executed: list[str], rows: DataFrame) -> DataFrame:
    """(_file, _sheet, rule_id, n, ok, request): for each sheet and executed rule how many groups touch it; rows as group_rows() gives them."""
    every = sheets.select("_file", "_sheet").distinct().select("_file", "_sheet", F.explode(F.array(*map(F.lit, sorted(set(executed))))).alias("rule_id"))
    touched = rows.select("_file", "_sheet", "rule_id", "group_id", "disposition").distinct()
    counts = touched.groupBy("_file", "_sheet", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("disposition") == "ok").alias("ok"))
    out = every.join(counts, ["_file", "_sheet", "rule_id"], "left").fillna(0, ["n", "ok"])
    return out.withColumn("request", F.col("n") - F.col("ok"))


def change_list(found: DataFrame, deleted: DataFrame, json_rows: bool = False) -> DataFrame:
    """(_file, _sheet, _row, place, column, status, rule_id, before, after): a line for each detail, then for each deleted row.

    part and the columns after it give the order in a sheet: details by row and
    column (part 0), deleted rows by row (part 1).  json_rows: places count records
    from [0] instead of rows.
    """
    place = F.concat(F.lit("["), (F.col("_row") - 2).cast("string"), F.lit("]")) if json_rows else F.col("_row").cast("string")
    none = F.lit(None).cast("string")
    gone = deleted.select("_file", "_sheet", "_row", F.lit(1).alias("part"), none.alias("column"), F.lit("deleted").alias("status"), F.lit("DUPLICATE_ROW").alias("rule_id"), none.alias("before"), none.alias("after"))
    lines = found.select("_file", "_sheet", "_row", F.lit(0).alias("part"), "column", "status", "rule_id", "before", "after").unionByName(gone)
    return lines.withColumn("place", place)


def visible_rows(df: DataFrame, marks: DataFrame, deleted: DataFrame, grouped: DataFrame, changed_only: bool = True, hide_auto: bool = False, number: int = 0, rows: int = 50) -> DataFrame:
    """A page of rows of one sheet: those deleted, in a group or with a visible mark, or all; hide_auto takes marks of automatic changes as not visible."""
    row = ["_file", "_sheet", "_row"]
    seen = marks.where("status not in ('auto', 'auto_pending')") if hide_auto else marks
    touched = seen.select(*row).union(deleted.select(*row)).union(grouped.select(*row)).distinct()
    return (df.join(touched, row, "left_semi") if changed_only else df).orderBy(*row).offset(number * rows).limit(rows)
