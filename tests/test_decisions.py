from pyspark.sql import functions as F

from paylint.operators import cells, decisions, reports


def test_last_decision_order_and_dropped_rows(spark):
    rows = [("f", "s", 2, "1,000", "a"), ("f", "s", 3, "1,000", "a"), ("f", "s", 4, "1,000", "a"), ("f", "s", 5, "7", "b")]
    df = spark.createDataFrame(rows, "_file string, _sheet string, _row long, x string, y string")
    checks = [cells.issue("x", rule, "auto", F.col("x").contains(","), suggestion=F.lit(to)) for rule, to in (("A", "first"), ("B", "second"), ("C", "third"))]
    found = cells.collected(df, checks)
    issues = found.unionByName(cells.duplicate_issues(df, ["x", "y"]))
    ids = {(r["_row"], r["rule_id"]): r["issue_id"] for r in issues.collect()}
    log = [(ids[2, r], "apply", None, "system", 0) for r in "ABC"] + [(ids[4, "A"], "apply", None, "system", 0), (ids[4, "A"], "edit", "9", "operator", 1)]
    log += [(ids[3, "DUPLICATE_ROW"], "reject", None, "operator", 1), (ids[3, "DUPLICATE_ROW"], "apply", None, "operator", 2), (ids[4, "DUPLICATE_ROW"], "apply", None, "operator", 1), (ids[4, "DUPLICATE_ROW"], "reject", None, "operator", 2)]
    decided = spark.createDataFrame(log, "issue_id string, action string, value string, decided_by string, seq int")
    changed = decisions.changes(issues, decided)
    got = sorted((r["_row"], r["rule_id"], r["before"], r["after"] or "") for r in changed.collect())
    assert got == [(2, "A", "1,000", "first"), (2, "B", "first", "second"), (2, "C", "second", "third"), (3, "DUPLICATE_ROW", "1,000", ""), (4, "A", "1,000", "9")]
    assert [r["_row"] for r in reports.deleted_rows(changed).collect()] == [3]
    assert sorted((r["_row"], r["x"]) for r in decisions.cleaned(df, changed, ["x", "y"]).collect()) == [(2, "third"), (4, "9"), (5, "7")]
    status = {(r["_row"], r["rule_id"]): r["status"] for r in reports.details(issues, decided, changed, finalized=False).collect()}
    assert status[4, "DUPLICATE_ROW"] == "rejected" and (3, "DUPLICATE_ROW") not in status
