import pytest
from pyspark.sql import functions as F

from paylint.functions import masking, normalize


def values(spark, f, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_amounts(spark):
    given = {"1,000,000": 1000000, "₩5,000": 5000, "１２，０００": 12000, "5천만원": 50000000, "1억 2천만": 120000000, "3만5천": 35000, "1.5억": 150000000, "천": 1000, "0": 0, "-500": -500, "abc": None, "10.5": None, "": None}
    given |= {"-5만": None, "1e5": 100000, "+500": 500, "1_000": 1000, "억": None, "만5천": None, "원": None, "0원": 0, "-500원": -500, "5백": 500, "1.5만": 15000, "1.2.3만": None, "3천5백20": 3520, "10.5만원": 105000, "0만": 0, "7,132원": 7132, "1 억 2천 만원": 120000000, "inf": None, "KRW 12": 12, "1.00": 1, "-0": 0, "１．５억": 150000000}
    got = values(spark, normalize.amount, given)
    assert [None if x is None else int(x) for x in got] == list(given.values())


def test_dates(spark):
    given = {"2026-3-5": ("2026-03-05", True), "2026.03.05.": ("2026-03-05", True), "20260305": ("2026-03-05", True), "2026년 3월 5일": ("2026-03-05", True), "2026-03-05 10:20": ("2026-03-05", True), "45000": ("2023-03-15", True), "13/02/2026": ("2026-02-13", True), "02/13/2026": ("2026-02-13", True), "03/04/2026": ("2026-03-04", False), "2026-02-30": (None, False), "내일": (None, False)}
    got = values(spark, normalize.date, given)
    assert [(str(r["value"]) if r["value"] else None, r["certain"]) for r in got] == list(given.values())


def test_more_dates(spark):
    """Cells with two-digit years, odd white space and the older list of layouts."""
    given = {"26-03-05": ("2026-03-05", False), "2026.  3. 5": ("2026-03-05", True), "2026년3월5": ("2026-03-05", True), "045000": ("2023-03-15", True), "05/05/2026": ("2026-05-05", False), "30/02/2026": (None, False), "2026-03-05T10:20:30Z": ("2026-03-05", True), "2026-03-05 1:20": (None, False), "20261305": (None, False), "26.13.05": (None, False)}
    got = values(spark, normalize.date, given)
    assert [(str(r["value"]) if r["value"] else None, r["certain"]) for r in got] == list(given.values())
    assert str(values(spark, lambda c: normalize.date(c, ("2026-01-01", "2026-12-31")), ["26-03-05"])[0]["value"]) == "2026-03-05"
    older = {"2026-03-05": "2026-03-05", "2026-3-5": None, "2026.03.05": "2026-03-05", "2026.03.05.": None, "03/04/2026": "2026-03-04", "13/02/2026": None, "26-03-05": None, "2026년 3월 5일": None, "2026-03-05 10:20": "2026-03-05", "45000": None}
    assert [str(r["value"]) if r["value"] else None for r in values(spark, normalize.simple_date, older)] == list(older.values())


def test_business_numbers(spark):
    texts = ["1248100998", "124-81-00999", "12345"]
    assert values(spark, normalize.check_digit_ok, texts) == [True, False, None]
    assert values(spark, normalize.business_number, texts) == ["124-81-00998", "124-81-00999", None]


def test_small_ones(spark):
    assert values(spark, normalize.is_blank, ["", "-", "n/a", "없음", "　", None, "N/A", "NA", "0"]) == [True] * 6 + [False] * 3
    assert values(spark, normalize.phone, ["01012345678", "0551234567", "12345"]) == ["010-1234-5678", "055-123-4567", None]
    assert values(spark, normalize.text, ["㈜가나", "ＡＢＣ", "a  b"]) == ["(주)가나", "ABC", "a b"]
    assert values(spark, normalize.year, ["2026-03-05", "20260305", "26-03-05"]) == ["2026", "2026", None]
    assert values(spark, masking.business_number, ["1248100998"]) == ["124-81-*****"]
    assert values(spark, masking.business_cell, ["123456789", "12345", "12"]) == ["123-45-****", "*****", "12"]
    assert values(spark, masking.in_text, ["번호 124-81-00998 입니다"]) == ["번호 124-81-***** 입니다"]


@pytest.mark.parametrize("f", [normalize.business_number, normalize.phone, normalize.text])
def test_idempotent(spark, f):
    once = [x for x in values(spark, f, ["1248100998", "01012345678", "㈜가  나"]) if x]
    assert values(spark, f, once) == once
