"""Cell checks: all checks that look at one row share one scan and one array of issues; column profiles are joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylint.functions import normalize as N
from paylint.operators.selection import few, percentiles
from paylint.sources.tables import saved

KEYS = ["_file", "_sheet", "_row"]


def issue(column: str, rule: str, tier: str, when: Column, value: Column | None = None, suggestion: Column | None = None, kind: str = "rule") -> Column:
    """A struct of an issue where the condition holds, else null."""
    none = F.lit(None).cast("string")
    return F.when(when, F.struct(F.lit(column).alias("column"), F.lit(rule).alias("rule_id"), F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), (F.col(f"`{column}`") if value is None else value).cast("string").alias("value"), (none if suggestion is None else suggestion.cast("string")).alias("suggestion"), F.col(f"`{column}`").cast("string").alias("cell")))


def collected(df: DataFrame, found: list[Column]) -> DataFrame:
    """One row for each issue, with an id made from its content; cell is what the cell holds, seq the place of the check."""
    numbered = F.filter(F.transform(F.array(*found), lambda x, i: F.when(x.isNotNull(), F.struct(x.alias("x"), i.alias("seq")))), lambda s: s.isNotNull())
    return _named(df.select(*KEYS, F.inline(numbered)).select(*KEYS, "x.*", "seq"))


def _named(rows: DataFrame) -> DataFrame:
    key = F.concat_ws("|", "rule_id", "_file", "_sheet", F.col("_row").cast("string"), "column", F.coalesce("value", F.lit("")))
    return rows.withColumn("issue_id", F.substring(F.sha2(key, 256), 1, 16))


def _is_blank(df: DataFrame | None, c: str) -> Column:
    """Whether a cell is blank, as parsed() has worked it out for df, if it has."""
    return F.col(f"`_blank_{c}`") if df is not None and f"_blank_{c}" in df.columns else N.is_blank(F.col(f"`{c}`"))


def blank(df: DataFrame, columns: list[str], required: list[str]) -> list[Column]:
    empty = _is_blank(df, columns[0])
    for c in columns[1:]:
        empty = empty & _is_blank(df, c)
    out = [issue(columns[0], "BLANK", "auto", empty, F.lit("(빈 행)"))]
    for c in columns:
        squeezed = F.col(f"`_squeezed_{c}`") if f"_squeezed_{c}" in df.columns else N.squeeze(F.col(f"`{c}`"))
        if c in required:
            out.append(issue(c, "BLANK", "request", _is_blank(df, c) & ~empty))
        changed = squeezed.isNotNull() & (~_is_blank(df, c) if c in required else F.lit(True)) & ~empty
        out.append(issue(c, "BLANK", "auto", changed, suggestion=squeezed))
    return out


def parsed(df: DataFrame, amounts: list[str] = (), dates: list[str] = (), units: dict[str, str] | None = None, periods: dict[str, tuple[str, str]] | None = None, blanks: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """df with the normalised values that the checks look at, each worked out once for a row.

    units: the unit in the header of a column of amounts.  periods: first and last day of a column of dates.
    blanks: columns whose blank cells and white space are looked at.  numbers: columns of business numbers.
    """
    units, periods = units or {}, periods or {}
    cell = lambda c: F.col(f"`{c}`")
    new = {f"_amount_{c}": N.amount(cell(c), units.get(c)) for c in amounts} | {f"_certain_{c}": N.amount_certain(cell(c), units.get(c)) for c in amounts}
    new |= {f"_date_{c}": N.date(cell(c), periods.get(c)) for c in dates}
    new |= {f"_blank_{c}": N.is_blank(cell(c)) for c in dict.fromkeys([*blanks, *amounts, *dates, *numbers])} | {f"_squeezed_{c}": N.squeeze(cell(c)) for c in blanks}
    return df.withColumns(new | {f"_number_{c}": F.struct(N.business_number(cell(c)).alias("canonical"), N.check_digit_ok(cell(c)).alias("ok")) for c in numbers})


def amount(c: str, df: DataFrame | None = None) -> list[Column]:
    """On df from parsed()."""
    cell = F.col(f"`{c}`")
    value, there = F.col(f"_amount_{c}"), ~_is_blank(df, c)
    changed, certain = there & (value.cast("string") != cell), F.col(f"_certain_{c}")
    return [
        issue(c, "AMOUNT_NORMALIZE", "approval", there & value.isNull()),
        issue(c, "AMOUNT_NORMALIZE", "auto", changed & certain, suggestion=value),
        issue(c, "AMOUNT_NORMALIZE", "approval", changed & ~certain, suggestion=value),
    ]


def date(c: str, lo: str | None = None, hi: str | None = None, df: DataFrame | None = None) -> list[Column]:
    """On df from parsed()."""
    cell = F.col(f"`{c}`")
    read, there = F.col(f"_date_{c}"), ~_is_blank(df, c)
    value = read["value"].cast("string")
    changed = there & (value != cell)
    out = [
        issue(c, "DATE_NORMALIZE", "request", there & value.isNull()),
        issue(c, "DATE_NORMALIZE", "auto", changed & read["certain"], suggestion=value),
        issue(c, "DATE_NORMALIZE", "approval", changed & ~read["certain"], suggestion=value),
    ]
    if lo and hi:
        out.append(issue(c, "DATE_OUT_OF_RANGE", "request", there & ~read["value"].between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), value))
    return out


def business_number(c: str, df: DataFrame | None = None) -> list[Column]:
    cell = F.col(f"`{c}`")
    ready = df is not None and f"_number_{c}" in df.columns
    there = ~_is_blank(df, c)
    canonical, ok = (F.col(f"`_number_{c}`")["canonical"], F.col(f"`_number_{c}`")["ok"]) if ready else (N.business_number(cell), N.check_digit_ok(cell))
    return [
        issue(c, "BIZNO_FORMAT", "request", there & canonical.isNull()),
        issue(c, "BIZNO_VERIFY", "auto", there & (canonical != cell), suggestion=canonical),
        issue(c, "BIZNO_CHECKSUM", "approval", there & ~ok),
    ]


def phone(c: str) -> list[Column]:
    cell = F.col(f"`{c}`")
    fixed, there = N.phone(cell), ~N.is_blank(cell)
    return [issue(c, "PHONE_FORMAT", "approval", there & fixed.isNull()), issue(c, "PHONE_FORMAT", "auto", there & (fixed != cell), suggestion=fixed)]


def text(c: str) -> list[Column]:
    cell = F.col(f"`{c}`")
    return [issue(c, "TEXT_NORMALIZE", "auto", N.text(cell) != cell, suggestion=N.text(cell))]


def code(df: DataFrame, c: str, codes: DataFrame, rows: int = 100_000) -> DataFrame:
    """Issues for trimmed values that are not in codes (code); the codebook is broadcast up to `rows` rows."""
    book = codes.select(F.trim("code").alias("_code")).where("_code is not null").distinct()
    book = F.broadcast(book) if book.limit(rows + 1).count() <= rows else book
    bad = df.where(~N.is_blank(F.col(f"`{c}`"))).join(book, F.trim(F.col(f"`{c}`")) == F.col("_code"), "left_anti")
    return collected(bad, [issue(c, "CODE_VALID", "approval", F.lit(True))])


def type_consistency(df: DataFrame, c: str) -> DataFrame:
    """Values whose kind differs from the column's majority in their file and sheet; of equals the kind seen first."""
    kinds = df.select(*KEYS, F.col(f"`{c}`"), N.kind(F.col(f"`{c}`")).alias("_kind")).where("_kind != 'empty'")
    counts = kinds.groupBy("_file", "_sheet", "_kind").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first"))
    top = counts.groupBy("_file", "_sheet").agg(F.max_by("_kind", F.struct("n", -F.col("first"))).alias("_most"), F.sum("n").alias("_n"))
    odd = kinds.join(top, ["_file", "_sheet"]).where("_n >= 2 and _kind != _most")
    return collected(odd, [issue(c, "TYPE_CONSISTENCY", "approval", F.lit(True))])


def outlier(df: DataFrame, c: str, by: list[str], iqr: float = 1.5, times: float = 5.0, value: Column | None = None) -> DataFrame:
    """Numbers outside the quartiles by `iqr` times their distance, or above `times` a positive mean; groups have four numbers at least."""
    x = df.withColumn("_x", F.col(f"`{c}`").try_cast("double") if value is None else value).where("_x is not null")
    mean_of = x.groupBy(*by).agg(F.avg("_x").alias("_mean"))
    stats = percentiles(x, by, F.col("_x"), [0.25, 0.75]).where("n >= 4").select(*(F.col(f"`{k}`") for k in by), F.col("q0").alias("_q1"), F.col("q1").alias("_q3"))
    same = lambda a, b: F.expr(" and ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in by))
    quartiles = stats.alias("s").join(mean_of.alias("m"), same("s", "m")).select("s.*", "m._mean")
    # few groups are sent to the rows, or all rows of a group would meet in one task
    quartiles = few(saved(quartiles))
    joined = x.alias("v").join(quartiles.alias("s"), same("v", "s")).select("v.*", "s._q1", "s._q3", "s._mean")
    q1, q3, mean = F.col("_q1"), F.col("_q3"), F.col("_mean")
    far = F.when((mean > 0) & (F.col("_x") > mean * times), "mean").when(F.col("_x") < q1 - iqr * (q3 - q1), "low").when(F.col("_x") > q3 + iqr * (q3 - q1), "high")
    return joined.withColumn("outlier", far).where("outlier is not null").drop("_q1", "_q3")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """All rows but the first with equal values in all columns of a sheet: (완전중복) in the same file, (파일간중복) in another."""
    same = df.groupBy("_sheet", *columns).agg(F.min(F.struct("_file", "_row")).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    on = [F.col(f"d.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in ["_sheet", *columns]]
    later = df.alias("d").join(same.alias("s"), on).where("struct(d._file, d._row) != s.first")
    return later.select("d._file", "d._sheet", "d._row", F.when(F.col("s.first._file") == F.col("d._file"), "(완전중복)").otherwise("(파일간중복)").alias("value"), F.lit("DUPLICATE_ROW").alias("rule_id"), F.lit("approval").alias("tier"), F.col("s.first._file").alias("first_file"), F.col("s.first._row").alias("first_row"))


def duplicate_issues(df: DataFrame, columns: list[str]) -> DataFrame:
    """duplicate_rows as issues of the first of the columns, to put beside those of the cells."""
    c, none = columns[0], F.lit(None).cast("string")
    rows = duplicate_rows(df, columns).select(*KEYS, F.lit(c).alias("column"), "rule_id", "tier", F.lit("rule").alias("kind"), "value", none.alias("suggestion"))
    return _named(rows.join(df.select(*KEYS, F.col(f"`{c}`").cast("string").alias("cell")), KEYS).withColumn("seq", F.lit(None).cast("int")))
