"""Triage of issues, decisions, fixing, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylint.functions import normalize as N
from paylint.operators.registered import numeric_clean
from paylint.sources.tables import saved

CELL = ["_file", "_sheet", "_row", "column"]


def escalated(issues: DataFrame) -> DataFrame:
    """Cells with two or more different suggestions move a tier up; duplicate rows always need approval."""
    many = issues.groupBy(*CELL).agg(F.count_distinct("suggestion").alias("_n")).where("_n > 1")
    up = F.when(F.col("tier") == "auto", "approval").otherwise("request")
    tier = F.when(F.col("rule_id") == "DUPLICATE_ROW", "approval").when(F.col("_n").isNotNull(), up).otherwise(F.col("tier"))
    return issues.join(many, CELL, "left").withColumn("tier", tier).drop("_n")


def system_decisions(issues: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Decisions for issues without one: auto is applied, request is asked for, approval waits."""
    open_ = issues if decided is None else issues.join(decided.select("issue_id"), "issue_id", "left_anti")
    return open_.where("tier != 'approval'").select("issue_id", F.when(F.col("tier") == "auto", "apply").otherwise("request").alias("action"), F.lit(None).cast("string").alias("value"), F.lit("system").alias("decided_by"))


def approved_decisions(issues: DataFrame) -> DataFrame:
    """Decisions of a batch run: auto is applied by the system, approval by the operator, the rest is asked for."""
    tier = F.col("tier")
    return issues.select("issue_id", F.when(tier.isin("auto", "approval"), "apply").otherwise("request").alias("action"), F.lit(None).cast("string").alias("value"), F.when(tier == "approval", "operator").otherwise("system").alias("decided_by"))


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each issue: that with the greatest seq, a column that may be missing; of equals an operator's."""
    seq = F.col("seq") if "seq" in decisions.columns else F.lit(0)
    taken = F.struct("action", "value", "decided_by")
    last = decisions.groupBy("issue_id").agg(F.max_by(taken, F.struct(seq, F.col("decided_by") == "operator", "action", "value")).alias("_d"))
    return last.select("issue_id", "_d.*")


#: Rules of findings that no rule can apply: their issues are for operators to answer.
UNAPPLIED = ("AMOUNT_SUSPECT_UNIT", "BIZNO_FORMAT", "BIZNO_NOT_FOUND", "BIZNO_SUSPENDED", "BIZNO_UNVERIFIED", "BIZNO_CLOSED_BEFORE_SUPPORT", "BIZNO_CLOSED_AFTER_SUPPORT", "DATE_OUT_OF_RANGE")


def fixed(rule: Column, cell: Column) -> Column:
    """What a rule makes of a cell as it is now; null for rules that make nothing, and where they can't read it."""
    old = N.simple_date(cell)
    forms = {
        "BLANK": F.coalesce(F.nullif(N.squeeze(cell), F.lit("")), cell),
        "AMOUNT_NORMALIZE": N.amount(cell).cast("string"),
        "NUMERIC_UNIT": numeric_clean(cell),
        "DATE_NORMALIZE": N.date(cell)["value"].cast("string"),
        "DATE_FORMAT": F.when(~old["ambiguous"], old["value"].cast("string")),
        "BIZNO_VERIFY": N.business_number(cell),
        "BIZNO_CHECKSUM": F.when(N.check_digit_ok(cell), N.business_number(cell)),
        "PHONE_FORMAT": N.phone(cell),
        "TEXT_NORMALIZE": N.text(cell),
    }
    out = F.lit(None).cast("string")
    for name, form in forms.items():
        out = F.when(rule == name, form).otherwise(out)
    return out


def changes(issues: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """What applying the decisions changes, a row for each change of a cell: (issue_id, cell, rule_id, tier, before, after, decided_by, step, change_id, timestamp).

    The last decision of an issue counts; without decisions those of the system do,
    which need no join.  Issues of one cell are applied in the order of their checks
    (seq of the issues), each to what the one before left: edit puts in the given
    value, apply what the rule makes of the cell as it is then, or else the issue's
    suggestion, or else nothing.  Rules in UNAPPLIED are never applied.  step counts
    the changes of a cell.  An applied duplicate row is a change with after null, the
    last of its cell: the row is dropped.  change_id follows from issue and step.

    A cell's issues, at most one a check or two, are folded in one task.
    """
    if decisions is None:
        rows = issues.where("tier = 'auto'").withColumns({"action": F.lit("apply"), "d_value": F.lit(None).cast("string"), "decided_by": F.lit("system")})
    else:
        rows = issues.join(last_decisions(decisions).withColumnRenamed("value", "d_value"), "issue_id")
    applies = (F.col("action") == "apply") & ~F.col("rule_id").isin(*UNAPPLIED)
    rows = rows.where(applies | ((F.col("action") == "edit") & F.col("d_value").isNotNull()))
    seq = F.col("seq").cast("int") if "seq" in issues.columns else F.lit(None).cast("int")
    drops = (F.col("rule_id") == "DUPLICATE_ROW") & (F.col("action") == "apply")
    place = F.struct(drops.alias("drops"), seq.isNull().alias("late"), seq.alias("seq"), "issue_id", "rule_id", "tier", "decided_by", "action", "d_value", "suggestion")
    cell = (F.col("cell") if "cell" in issues.columns else F.col("value")).cast("string")
    # rows of a sheet's row meet once, for the folds, for cleaned() and for whatever else goes by row
    together = rows.repartition("_file", "_sheet", "_row").groupBy(*CELL).agg(F.min(cell).alias("cell"), F.sort_array(F.collect_list(place)).alias("steps"))
    made = "array<struct<issue_id: string, rule_id: string, tier: string, before: string, after: string, decided_by: string, step: int>>"
    start = F.struct(F.col("cell").alias("cell"), F.array().cast(made).alias("made"))

    def apply(acc: Column, x: Column) -> Column:
        after = F.when(x["action"] == "edit", x["d_value"]).when(~x["drops"], F.coalesce(fixed(x["rule_id"], acc["cell"]), x["suggestion"]))

        def put(after: Column) -> Column:
            change = F.struct(x["issue_id"].alias("issue_id"), x["rule_id"].alias("rule_id"), x["tier"].alias("tier"), acc["cell"].alias("before"), after.alias("after"), x["decided_by"].alias("decided_by"), (F.size(acc["made"]) + 1).alias("step"))
            return F.struct(F.coalesce(after, acc["cell"]).alias("cell"), F.when(x["drops"] | after.isNotNull(), F.concat(acc["made"], F.array(change).cast(made))).otherwise(acc["made"]).alias("made"))

        return N.let(after, put)

    folded = together.select(*CELL, F.inline(F.aggregate("steps", start, apply)["made"]))
    change_id = F.concat(F.lit("C-"), F.substring(F.sha2(F.concat_ws("|", "issue_id", F.col("step").cast("string")), 256), 1, 12))
    return folded.select("issue_id", *CELL, "rule_id", "tier", "before", "after", "decided_by", "step", change_id.alias("change_id"), F.current_timestamp().alias("timestamp"))


def fingerprint(decisions: DataFrame) -> DataFrame:
    """(basis): twelve hex digits that change with the operators' decisions; those of the system don't count.

    Decisions are hashed one by one and the hashes summed, so none are gathered.
    """
    said = F.to_json(F.struct("issue_id", "action", F.coalesce("value", F.lit("")).alias("value")))
    total = F.sum(F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("decimal(38,0)"))
    return decisions.where("decided_by = 'operator'").agg(F.substring(F.sha1(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.coalesce(total, F.lit(0)).cast("string"))), 1, 12).alias("basis"))


def is_stale(basis: str | None, decisions: DataFrame) -> bool:
    """Whether operators have decided otherwise since group rules ran on the given basis; without one nothing is stale."""
    return basis is not None and fingerprint(decisions).first()["basis"] != basis


def rechecked(issues_of, cleaned_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The issues that remain when the checks run again on cleaned rows, and a row (passed, remaining)."""
    remaining = issues_of(cleaned_rows)
    return remaining, remaining.agg((F.count(F.lit(1)) == 0).alias("passed"), F.count(F.lit(1)).alias("remaining"))


def valid_edits(edits: DataFrame, issues: DataFrame) -> DataFrame:
    """(issue_id, cell, rule_id, stored, error) for each edit (issue_id, value) of an issue.

    A value that its rule can read is stored in that rule's own layout; rules
    without a layout store what was typed.  error is ``empty`` or ``unreadable``, else null.
    """
    typed = N.strip(F.col("typed"))
    rule = F.col("rule_id")
    read = F.when(rule.startswith("AMOUNT"), N.amount(typed).cast("string")).when(rule == "DATE_FORMAT", N.simple_date(typed)["value"].cast("string")).when(rule.startswith("DATE"), N.date(typed)["value"].cast("string")).when(rule.startswith("BIZNO"), F.when(N.check_digit_ok(typed), N.business_number(typed))).otherwise(typed)
    rows = issues.join(edits.select("issue_id", F.col("value").alias("typed")), "issue_id")
    empty = F.coalesce(typed, F.lit("")) == ""
    out = rows.withColumn("stored", F.when(~empty, read)).withColumn("error", F.when(empty, "empty").when(F.col("stored").isNull(), "unreadable"))
    return out.select("issue_id", *CELL, "rule_id", "stored", "error")


def cleaned(df: DataFrame, changed: DataFrame, columns: list[str]) -> DataFrame:
    """df with the last change of each cell put in, without the rows that a change with after null drops."""
    place = {c: f"_new_{i}" for i, c in enumerate(df.columns) if c in columns}
    # the changes of a row meet in one aggregation: a change's text and step count for its own column alone
    of = lambda c, x: F.when(F.col("column") == c, F.col(x))
    by_row = changed.groupBy("_file", "_sheet", "_row").agg(*(F.max_by(of(c, "after"), of(c, "step")).alias(n) for c, n in place.items()), F.bool_or(F.col("after").isNull()).alias("_gone"))
    joined = df.join(by_row, ["_file", "_sheet", "_row"], "left").where("not coalesce(_gone, false)")
    return joined.select(*(F.coalesce(F.col(place[c]), F.col(f"`{c}`")).alias(c) if c in place else F.col(f"`{c}`") for c in df.columns))


def summary(issues: DataFrame) -> DataFrame:
    """Counts by tier, by rule and by file, as (kind, item, n), from one pass."""
    sets = issues.groupingSets([["tier"], ["rule_id"], ["_file"]], "tier", "rule_id", "_file").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.when(F.col("tier").isNotNull(), "tier").when(F.col("rule_id").isNotNull(), "rule").otherwise("file").alias("kind"), F.coalesce("tier", "rule_id", "_file").alias("item"), "n")


def file_tiers(issues: DataFrame) -> DataFrame:
    """(_file, auto, approval, request, total): issues of each file by tier, and all of them."""
    counts = issues.groupBy("_file").pivot("tier", ["auto", "approval", "request"]).count().fillna(0)
    return counts.withColumn("total", F.col("auto") + F.col("approval") + F.col("request"))


def top_rules(issues: DataFrame, n: int = 5) -> DataFrame:
    return issues.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(n)


def scoped(issues: DataFrame, prefixes: list[str]) -> DataFrame:
    """Issues whose rule begins with one of the prefixes."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("rule_id").startswith(p)
    return issues.where(wanted)


def guarded(decisions: DataFrame, issues: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """Decisions on known issues in scope; a duplicate row is never dropped by the system."""
    known = issues if prefixes is None else scoped(issues, prefixes)
    rows = decisions.join(known.select("issue_id", "rule_id"), "issue_id")
    return rows.where(~((F.col("rule_id") == "DUPLICATE_ROW") & (F.col("action") == "apply") & (F.col("decided_by") == "system"))).drop("rule_id")


def to_ask(remaining: DataFrame, decisions: DataFrame, issues: DataFrame) -> DataFrame:
    """Remaining issues that need an answer: of tier request, or on a cell that had a decision to request."""
    asked = issues.join(decisions.where("action = 'request'").select("issue_id"), "issue_id").select(*CELL).distinct().withColumn("_asked", F.lit(True))
    return remaining.join(asked, CELL, "left").where("tier = 'request' or _asked").drop("_asked")


def bulk_duplicates(issues: DataFrame) -> DataFrame:
    return issues.where("rule_id = 'DUPLICATE_ROW' and tier = 'approval' and value = '(완전중복)'")


def report(issues: DataFrame) -> DataFrame:
    """One row: counts by rule and by tier as maps, and whether nothing remains. Only counts meet in the last task."""
    counts = saved(issues.groupBy("rule_id", "tier").agg(F.count(F.lit(1)).alias("n")))
    of = lambda key: counts.groupBy(key).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(f"by_{key}"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return of("rule_id").join(of("tier").drop("total"), F.lit(True)).withColumn("passed", F.col("total") == 0)
