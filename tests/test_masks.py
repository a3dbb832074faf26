"""Masks that SQL has no form for, against Python's patterns."""

import re

from pyspark.sql import functions as F

from paylint.functions import masking


def plain(t):
    t = re.sub(r"(?<![0-9])([0-9]{3})-?([0-9]{2})-?[0-9]{5}(?![0-9])", r"\1-\2-*****", t)
    t = re.sub(r"(?<![0-9])(0[0-9]{1,2})-([0-9]{3,4})-[0-9]{4}(?![0-9])", r"\1-\2-****", t)
    return re.sub(r"([A-Za-z0-9._%+-]{1,2})[A-Za-z0-9._%+-]*@", r"\1***@", t)


def test_contacts_in_documents(spark):
    """Whole texts of a table, and texts with numbers next to each other."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("text is not null")
    more = spark.createDataFrame([("124-81-00998 1248100998,055-123-4567 a@b.c abc.d@e",), ("1248100998 " * 3,), ("",)], "text string")
    rows = docs.union(more).select("text", masking.contacts(F.col("text")).alias("m")).collect()
    assert all(r["m"] == plain(r["text"]) for r in rows) and any(r["m"] != r["text"] for r in rows)


def test_company_and_cell(spark):
    given = {"(주)가나다": "(주)가○○", "가 주식회사": "○ 주식회사", "㈜한빛 전자": "㈜한○○○○", "유한회사": "유한회사", "": ""}
    got = spark.createDataFrame([(k,) for k in given], "x string").select(masking.company(F.col("x"))).collect()
    assert [r[0] for r in got] == list(given.values())
