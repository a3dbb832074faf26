from pyspark.sql import functions as F

from paylint.functions import normalize
from paylint.operators import cells, decisions, groups, strict


def test_short_years(spark):
    given = {"24.03.15": ("2024-03-15", True), "24-3-5": ("2024-03-05", False), "24/03/03": ("2024-03-03", True), "24.13.05": (None, False), "25.03.05": ("2025-03-05", True), "2024.03.05": ("2024-03-05", True)}
    df = spark.createDataFrame([(t,) for t in given], "x string")
    got = [r[0] for r in df.select(normalize.date(F.col("x"), ("2025-01-01", "2025-12-31"))).collect()]
    assert [(str(r["value"]) if r["value"] else None, r["certain"]) for r in got] == list(given.values())


def test_header_unit(spark):
    given = {"1,200": (12000000, False), "1.5": (15000, False), "-3": (-30000, False), "0.00001": (None, False), "3만": (30000, True), "５": (50000, False), "abc": (None, True)}
    df = spark.createDataFrame([(t,) for t in given], "x string")
    got = df.select(normalize.amount(F.col("x"), "만원"), normalize.amount_certain(F.col("x"), "만원")).collect()
    assert [(None if r[0] is None else int(r[0]), r[1]) for r in got] == list(given.values())


def test_near_payments_of_short_years(spark):
    rows = [("f", "s", i, "1248100998", "p", d, "500") for i, d in enumerate(("24.03.15", "2024-03-16"))]
    df = spark.createDataFrame(rows, "_file string, _sheet string, _row long, `사업자번호` string, `사업명` string, `지원일자` string, `지원금액` string")
    assert [r["n_rows"] for r in groups.near_payments(df, ["사업명"], 3).collect()] == [2]


def test_strict_dates_ask_for_short_years(spark):
    df = spark.createDataFrame([("f", "s", 2, "24.03.15"), ("f", "s", 3, "2024.03.15")], "_file string, _sheet string, _row long, x string")
    found = cells.collected(df, strict.date_format("x"))
    assert sorted((r["_row"], r["tier"], r["suggestion"]) for r in found.collect()) == [(2, "approval", None), (3, "auto", "2024-03-15")]
    edits = found.where("_row = 2").select("issue_id", F.lit("24.03.15").alias("value"))
    assert [r["error"] for r in decisions.valid_edits(edits, found).collect()] == ["unreadable"]
