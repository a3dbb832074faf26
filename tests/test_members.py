from paylint.operators import decisions, groups


def test_members(spark):
    rows = [("f", "s", 2, "1248100998", "p", "2024-03-15", "500"), ("f", "s", 3, "124-81-00998", "p", "2024-05-15", "600"), ("f", "s", 4, "1248100998", "q", "2024-05-15", "700"), ("f", "s", 5, None, "p", None, "900"), ("f", "s", 6, None, "p", None, "900")]
    df = spark.createDataFrame(rows, "_file string, _sheet string, _row long, `사업자번호` string, `사업명` string, `지원일자` string, `지원금액` string")
    keys = ["사업자번호", "사업명"]
    for found, wanted in ((groups.max_count(df, keys), [2, 3, 5, 6]), (groups.sum_limit(df, ["사업자번호"], 1500, "per_business"), [5, 6])):
        assert sorted(r["_row"] for r in groups.members(df, found, keys).collect()) == wanted


def test_approved_decisions(spark):
    issues = spark.createDataFrame([("a", "auto"), ("b", "approval"), ("c", "request")], "issue_id string, tier string")
    got = sorted((r["issue_id"], r["action"], r["decided_by"]) for r in decisions.approved_decisions(issues).collect())
    assert got == [("a", "apply", "system"), ("b", "apply", "operator"), ("c", "request", "system")]
