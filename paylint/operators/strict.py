"""Checks of listed columns alone, strict numbers and dates, serial dates, and where the rows of a group are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylint.functions import masking
from paylint.functions import normalize as N
from paylint.operators.cells import issue

#: Cells that the date format check passes over, lower-cased.
NO_DATE = ["", "-", "n/a", "nan", "nat", "none", "null"]
#: Row numbers named for a sheet before the rest is only counted.
SHOWN = 8


def blank_listed(columns: list[str]) -> list[Column]:
    """A request for each blank cell of the listed columns; whole rows and white space are not looked at."""
    return [issue(c, "BLANK", "request", N.is_blank(F.col(f"`{c}`"))) for c in columns]


def required(columns: list[str]) -> list[Column]:
    """A request for each cell that is empty or says nan or none."""
    return [issue(c, "REQUIRED", "request", F.coalesce(F.lower(N.strip(F.col(f"`{c}`"))), F.lit("")).isin("", "nan", "none"), F.lit("(공백)")) for c in columns]


def iso_date_range(c: str, lo: str, hi: str) -> list[Column]:
    """A request for each ISO date (with or without dashes) outside the range; other cells are not looked at."""
    cell = N.strip(F.col(f"`{c}`"))
    day = F.when(cell.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), cell.try_cast("date")).when(cell.rlike("^[0-9]{8}$"), F.regexp_replace(cell, "^(....)(..)(..)$", "$1-$2-$3").try_cast("date"))
    return [issue(c, "DATE_RANGE", "request", ~day.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), cell)]


#: JSON types of a schema and the variant types that satisfy them.
JSON_TYPES = {"string": "STRING", "integer": "(BIGINT|DECIMAL\\(.*\\)|DOUBLE|FLOAT)", "number": "(BIGINT|DECIMAL\\(.*\\)|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>", "null": "VOID"}


def _violations(v: Column, schema: dict, at: str) -> list[Column]:
    value = F.try_variant_get(v, at, "variant")
    there, out = value.isNotNull(), []
    kind = F.schema_of_variant(value)
    if "type" in schema:
        fits = kind.rlike(f"(?s)^{JSON_TYPES[schema['type']]}$")
        if schema["type"] == "integer":
            # 1.0 and 1e2 are integers, however wide; decimals are compared by their digits
            text, real = F.try_variant_get(v, at, "string"), F.try_variant_get(v, at, "double")
            fits = fits & F.when(kind.startswith("DECIMAL"), text.rlike("^-?[0-9]+([.]0*)?$")).when(kind.isin("DOUBLE", "FLOAT"), real % 1 == 0).otherwise(F.lit(True))
        out.append(F.when(there & ~F.coalesce(fits, F.lit(False)), F.lit(f"{at}: not {schema['type']}")))
    if "enum" in schema:
        out.append(F.when(there & ~F.coalesce(F.try_variant_get(v, at, "string").isin([str(x) for x in schema["enum"]]), F.lit(False)), F.lit(f"{at}: not in enum")))
    number = F.try_variant_get(v, at, "double")
    numeric = there & kind.rlike(f"^{JSON_TYPES['number']}$")
    if "minimum" in schema:
        out.append(F.when(numeric & (number < schema["minimum"]), F.lit(f"{at}: below minimum")))
    if "maximum" in schema:
        out.append(F.when(numeric & (number > schema["maximum"]), F.lit(f"{at}: above maximum")))
    if "pattern" in schema:
        out.append(F.when(there & (kind == "STRING") & ~F.try_variant_get(v, at, "string").rlike(schema["pattern"]), F.lit(f"{at}: does not fit the pattern")))
    is_object = there & kind.startswith("OBJECT<")
    for name in schema.get("required", []):
        out.append(F.when(is_object & F.try_variant_get(v, f"{at}['{name}']", "variant").isNull(), F.lit(f"{at}: {name} is missing")))
    for name, inner in schema.get("properties", {}).items():
        out += [F.when(is_object, c) for c in _violations(v, inner, f"{at}['{name}']")]
    return out


def json_violation(text: Column, schema: dict) -> Column:
    """``not JSON``, or the first violation of a schema (type, enum, minimum, maximum, pattern, required, properties), or null; blank texts have none."""
    v = F.try_parse_json(text)
    first = F.coalesce(*(_violations(v, schema, "$") or [F.lit(None).cast("string")]))
    return F.when(N.strip(text) != "", F.when(v.isNull(), F.lit("not JSON")).otherwise(first))


def json_schema(df: DataFrame, c: str, schema: dict) -> DataFrame:
    """Issues (_file, _sheet, _row, column, rule_id, tier, value, message) for cells that are no JSON or break the schema, to be approved."""
    found = df.select("_file", "_sheet", "_row", F.col(f"`{c}`").alias("value"), json_violation(F.col(f"`{c}`"), schema).alias("message")).where("message is not null")
    return found.select("_file", "_sheet", "_row", F.lit(c).alias("column"), F.lit("JSON_SCHEMA").alias("rule_id"), F.lit("approval").alias("tier"), "value", "message")


def business_number(c: str) -> list[Column]:
    """A number without ten digits or with a wrong check digit is to be approved; a right one in another layout is rewritten."""
    cell = N.strip(F.col(f"`{c}`"))
    there, right, canonical = cell != "", F.coalesce(N.check_digit_ok(cell), F.lit(False)), N.business_number(cell)
    return [issue(c, "BIZNO_CHECKSUM", "approval", there & ~right, cell), issue(c, "BIZNO_CHECKSUM", "auto", there & right & (canonical != cell), cell, canonical)]


def date_format(c: str) -> list[Column]:
    """A date that the older list of layouts cannot read, or with a two-digit year, is to be approved; one in another layout than ISO is rewritten."""
    cell, read = N.strip(F.col(f"`{c}`")), N.simple_date(F.col(f"`{c}`"))
    value, there = read["value"].cast("string"), ~F.lower(cell).isin(NO_DATE)
    return [
        issue(c, "DATE_FORMAT", "approval", there & value.isNull()),
        issue(c, "DATE_FORMAT", "auto", there & (value != cell), suggestion=value),
    ]


def serial_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with spreadsheet day numbers as ISO dates, in the columns of a sheet that look like such numbers.

    A column of a sheet does if at least half of its rows are numbers and all of
    these are from 40,000 to 55,000.  One aggregation looks at all columns; its result
    has a row for each sheet, and the join is left to the optimizer.  Whole numbers
    alone are turned; null cells stay null; a null file or sheet is a sheet as well.
    """
    number = {c: F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None).cast("double")) for c in columns}
    looks = [(F.coalesce(2 * F.count(n) >= F.count(F.lit(1)), F.lit(False)) & F.coalesce((F.min(n) >= 40_000) & (F.max(n) <= 55_000), F.lit(False))).alias(f"_serial_{i}") for i, n in enumerate(number.values())]
    flags = df.groupBy(F.col("_file").alias("_f"), F.col("_sheet").alias("_s")).agg(*looks)
    joined = df.join(flags, F.col("_file").eqNullSafe(F.col("_f")) & F.col("_sheet").eqNullSafe(F.col("_s")))
    days = {c: F.trim(F.col(f"`{c}`")).try_cast("int") for c in columns}
    iso = {c: F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), n), "yyyy-MM-dd") for c, n in days.items()}
    whole = {c: F.trim(F.col(f"`{c}`")).rlike("^[0-9]+$") for c in columns}
    return joined.withColumns({c: F.when(F.col(f"_serial_{i}") & whole[c], iso[c]).otherwise(F.col(f"`{c}`")) for i, c in enumerate(columns)}).select(*(f"`{c}`" for c in df.columns))


def group_rows(found: DataFrame, key: list[str], number: str = "사업자번호") -> DataFrame:
    """(key, files, places, n_rows) of groups given as rows (key, _file, _sheet, _row): the business number is masked.

    Each sheet names its first rows and counts the others.  Rows are ranked within
    a sheet of a group, so that no array holds more than the rows that are named.
    """
    sheet = [*key, "_file", "_sheet"]
    rows = found.groupBy(*sheet, "_row").agg(F.count(F.lit(1)).alias("_times"))
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*sheet).orderBy("_row")))
    sheets = ranked.groupBy(*sheet).agg(F.sum("_times").alias("n"), F.count(F.lit(1)).alias("distinct"), F.array_sort(F.collect_list(F.when(F.col("_at") <= SHOWN, F.col("_row")))).alias("at"))
    named = F.concat(F.array_join(F.transform("at", lambda x: x.cast("string")), ", "), F.lit("행"), F.when(F.col("distinct") > SHOWN, F.concat(F.lit(" 외 "), (F.col("distinct") - SHOWN).cast("string"), F.lit("행"))).otherwise(F.lit("")))
    place = F.concat(F.col("_file"), F.lit(" · "), F.col("_sheet"), F.lit(" "), named)
    groups = sheets.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("_file")), ", ").alias("files"), F.array_sort(F.collect_list(F.struct("_file", "_sheet", place.alias("p")))).alias("_p"), F.sum("n").alias("n_rows"))
    shown = [masking.business_number(F.col(f"`{k}`")).alias(k) if k == number else F.col(f"`{k}`") for k in key]
    return groups.select(*shown, "files", F.array_join(F.col("_p.p"), " / ").alias("places"), "n_rows")
