"""Masks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import digits


def business_number(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 10, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.lit("*****"))).otherwise(c)


def in_text(c: Column) -> Column:
    """Business numbers inside a text keep their first five digits."""
    return F.regexp_replace(c, r"(?<![0-9])([0-9]{3})-([0-9]{2})-[0-9]{4,6}(?![0-9])", "$1-$2-*****")


def business_cell(c: Column) -> Column:
    """Ten digits as a business number; otherwise six or more keep five, four and five keep none, fewer are text."""
    d = digits(c)
    n = F.length(d)
    return F.when(n == 10, business_number(c)).when(n < 4, in_text(c)).when(n >= 6, F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 2), F.lit("-"), F.regexp_replace(F.substring(d, 6, 1 << 20), ".", "*"))).otherwise(F.regexp_replace(d, ".", "*"))


def contacts(c: Column) -> Column:
    """Business numbers lose five digits, phones four, e-mail names all but two characters."""
    c = F.regexp_replace(c, r"(?<![0-9])([0-9]{3})-?([0-9]{2})-?[0-9]{5}(?![0-9])", "$1-$2-*****")
    c = F.regexp_replace(c, r"(?<![0-9])(0[0-9]{1,2})-([0-9]{3,4})-[0-9]{4}(?![0-9])", "$1-$2-****")
    return F.regexp_replace(c, r"([A-Za-z0-9._%+-]{1,2})[A-Za-z0-9._%+-]*@", "$1***@")


#: Markers of a company's legal form.
MARKERS = ["주식회사", "유한회사", "(주)", "(유)", "㈜", "㈲"]


def company(c: Column) -> Column:
    """Markers of a legal form stay, and spaces around a name; of a name between them the first character is left, the rest are circles, all of a single character."""
    marker = "|".join(m.replace("(", "[(]").replace(")", "[)]") for m in MARKERS)

    def hidden(part: Column) -> Column:
        name = F.trim(part)
        circles = F.when(F.length(name) == 1, "○").otherwise(F.rpad(F.substring(name, 1, 1), F.length(name), "○"))
        return F.when(part.isin(MARKERS) | (name == ""), part).otherwise(F.replace(part, name, circles))

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(f"(?s)({marker}|(?:(?!{marker}).)+)"), F.lit(1)), hidden), "")


def cell(column: Column, value: Column) -> Column:
    """The mask that fits a column's name."""
    return F.when(column == "사업자번호", business_cell(value)).when(column == "수혜기업명", company(value)).otherwise(in_text(value))


def issues(df: DataFrame, columns: tuple[str, ...] = ("value", "suggestion")) -> DataFrame:
    """Issues or changes with values masked by the name of their column."""
    return df.withColumns({c: cell(F.col("column"), F.col(c)) for c in columns})


def findings(df: DataFrame) -> DataFrame:
    """Issues with numbers hidden in value, suggestion, message and explanation, as far as they have these.

    Issues of business numbers, by rule or column, have their cells masked as such and
    those cells' texts replaced in messages; all texts lose what looks like a number.
    """
    number = F.col("rule_id").startswith("BIZNO") | F.coalesce(F.col("column") == "사업자번호", F.lit(False))
    cells = [c for c in ("value", "suggestion") if c in df.columns]
    shown = {c: F.when(number, business_cell(F.col(c))).otherwise(in_text(F.col(c))) for c in cells}

    def message(c: str) -> Column:
        out = F.col(c)
        for raw in cells:
            out = F.when(number & (F.col(raw) != ""), F.replace(out, F.col(raw), business_cell(F.col(raw)))).otherwise(out)
        return in_text(out)

    return df.withColumns(shown | {c: message(c) for c in ("message", "explanation") if c in df.columns})


def changes(df: DataFrame) -> DataFrame:
    """Changes with numbers hidden in before and after."""
    number = F.col("column") == "사업자번호"
    return df.withColumns({c: F.when(number, business_cell(F.col(c))).otherwise(in_text(F.col(c))) for c in ("before", "after")})


def group_findings(df: DataFrame) -> DataFrame:
    """Group findings (group_key MAP, metric, and what findings() masks) with numbers hidden, to be saved."""
    key = F.transform_values("group_key", lambda k, v: F.when(k == "사업자번호", business_number(v)).otherwise(in_text(v)))
    texts = findings(df) if {"rule_id", "column"} <= set(df.columns) else df
    return texts.withColumns({"group_key": key, "metric": in_text(F.col("metric"))})
