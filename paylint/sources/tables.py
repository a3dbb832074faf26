"""Tables of raw values in and out: Parquet, CSV and JSON, with file, sheet and row numbers."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paylint.functions import normalize as N

META = ["_file", "_sheet", "_row"]


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset on a local master (tests), below a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = new_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, nested fields under dotted names, null as the empty string."""

    def leaves(schema, prefix=()):
        for f in schema.fields:
            path = (*prefix, f.name)
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, path)
            else:
                yield path, f.dataType

    def shown(path, kind):
        c = F.col(".".join(f"`{p}`" for p in path))
        return F.coalesce(F.to_json(c) if kind.typeName() in ("array", "map") else c.cast("string"), F.lit("")).alias(".".join(path))

    return df.select(*(shown(p, k) for p, k in leaves(df.schema)))


def load_parquet(spark: SparkSession, paths: list[str], sheet: str) -> DataFrame:
    """Parquet files as tables of text; _row is the row's place in its file, from 2."""
    df = spark.read.parquet(*paths)
    place = df.select("*", F.col("_metadata.file_name").alias("_file"), (F.col("_metadata.row_index") + 2).alias("_row"))
    text = as_text(place)
    return text.select("_file", F.lit(sheet).alias("_sheet"), F.col("_row").cast("long").alias("_row"), *(F.col(f"`{c}`") for c in text.columns if c not in META))


def load_csv(spark: SparkSession, paths: list[str], sheet: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV files with a header as tables of text; _row is the line's place in its file, from 2 (a record of several lines counts one)."""
    df = spark.read.csv(paths, header=True, encoding=encoding)
    names = [F.col(f"`{c}`") for c in df.columns]
    placed = df.select(*(F.coalesce(c, F.lit("")).alias(n) for c, n in zip(names, df.columns, strict=True)), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    # lines are numbered inside a split; the splits of a file are then put one after another
    per_split = Window.partitionBy("_file", "_start").orderBy("_id")
    numbered = placed.withColumn("_at", F.row_number().over(per_split))
    sizes = numbered.groupBy("_file", "_start").agg(F.max("_at").alias("_n"))
    before = sizes.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), (F.sum("_n").over(Window.partitionBy("_file").orderBy("_start")) - F.col("_n")).alias("_before"))
    joined = numbered.join(before, F.expr("_file = _f and _start = _s"))
    return joined.select("_file", F.lit(sheet).alias("_sheet"), (F.col("_at") + F.col("_before") + 1).cast("long").alias("_row"), *names)


def unsupported_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_file, key, reason) for what load_json() leaves out: files that are no JSON, scalars, empty lists, lists of other things than objects."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), F.try_parse_json("value").alias("v"))
    files.createOrReplaceTempView(view := f"json_{uuid.uuid4().hex}")
    reason = "CASE WHEN {0} LIKE 'ARRAY<VOID>' THEN 'empty list' WHEN {0} LIKE 'ARRAY<%' AND {0} NOT LIKE 'ARRAY<OBJECT<%' THEN 'list of other things than objects' END"
    # files are read once: an object gives a row for each key, anything else one row
    return spark.sql(
        f"""WITH top AS (SELECT _file, v, CASE WHEN v IS NOT NULL THEN schema_of_variant(v) END AS k FROM {view}),
        each AS (SELECT _file, k, t.key AS key, schema_of_variant(t.value) AS inner_ FROM top, LATERAL variant_explode_outer(CASE WHEN k LIKE 'OBJECT<%' THEN v END) AS t),
        told AS (SELECT _file, coalesce(key, '(file)') AS key, CASE WHEN k IS NULL THEN 'not JSON' WHEN k LIKE 'OBJECT<%' THEN {reason.format('inner_')} WHEN k NOT LIKE 'ARRAY<%' THEN 'neither list nor object' ELSE {reason.format('k')} END AS reason FROM each)
        SELECT * FROM told WHERE reason IS NOT NULL"""
    )


def json_records(original: DataFrame, cleaned: DataFrame, amounts: list[str] = ()) -> DataFrame:
    """original with the cells of cleaned in its own types, without the rows that cleaned lacks: to be written as JSON again.

    original: _file, _sheet, _row and columns as read, among them numbers; cleaned: the
    same columns as text.  A number stays one if the cleaned text still is, and so
    does a text of a column of amounts; anything else is the text.
    """
    keys = META
    texts = cleaned.select(*keys, *(F.col(f"`{c}`").alias(f"_new_{i}") for i, c in enumerate(original.columns) if c not in keys))
    joined = original.join(texts, keys)

    def back(i: int, c: str) -> list[Column]:
        kind, new, name = original.schema[c].dataType.typeName(), F.col(f"_new_{i}"), F.lit(c)
        number = kind in ("byte", "short", "integer", "long", "float", "double", "decimal") or c in amounts
        value = F.when(new.rlike("^-?(0|[1-9][0-9]*)([.][0-9]+)?$"), new).otherwise(F.to_json(F.array(new)).substr(F.lit(2), F.length(F.to_json(F.array(new))) - 2)) if number else F.to_json(F.array(new)).substr(F.lit(2), F.length(F.to_json(F.array(new))) - 2)
        return [F.concat(F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit(":"), F.coalesce(value, F.lit("null")))]

    pairs = [p for i, c in enumerate(original.columns) if c not in keys for p in back(i, c)]
    return joined.select(*keys, F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")).alias("record"))


def write_json_back(records: DataFrame, path: str) -> None:
    """json_records() as JSON lines in a folder for each file and sheet, in the order of rows."""
    records.repartition("_file", "_sheet").sortWithinPartitions("_file", "_sheet", "_row").select("_file", "_sheet", F.col("record").alias("value")).write.mode("overwrite").partitionBy("_file", "_sheet").text(path)


def load_issues(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A run's issues as they were written: empty texts are null, rows without an identifier, a rule or a readable row number are left out."""
    df = spark.read.parquet(path).where(F.col("run_id") == run_id)
    clean = df.select(*((F.nullif(F.col(f"`{c}`"), F.lit("")) if k == "string" else F.col(f"`{c}`")).alias(c) for c, k in df.dtypes))
    return clean.withColumn("_row", F.col("_row").try_cast("long")).where("issue_id is not null and rule_id is not null and _row is not null")


def cleaned_of_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The cleaned rows of a run, the input of the next one."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id).drop("run_id")


def last_dispositions(log: DataFrame) -> DataFrame:
    """(group_id, disposition): the last of each group by seq from a log that is only added to."""
    return log.groupBy("group_id").agg(F.max_by("disposition", F.struct("seq", "disposition")).alias("disposition"))


def load_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_file, _sheet, _row, record VARIANT): a row for each object of each list in JSON files.

    A list at the top is the table root, a list under a key is named by the key, an
    object without lists is a root of one row. A file is read whole by one task.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), F.try_parse_json("value").alias("v"))
    files.createOrReplaceTempView(view := f"json_{uuid.uuid4().hex}")
    kind = "regexp_extract(schema_of_variant({}), '^[A-Z]+', 0)"
    return spark.sql(
        f"""WITH top AS (SELECT _file, v, {kind.format('v')} AS k FROM {view} WHERE v IS NOT NULL),
        keys AS (SELECT _file, v, t.key, t.value FROM top, LATERAL variant_explode(v) AS t WHERE k = 'OBJECT'),
        lists AS (SELECT _file, 'root' AS _sheet, v AS value FROM top WHERE k = 'ARRAY' UNION ALL SELECT _file, key, value FROM keys WHERE {kind.format('value')} = 'ARRAY')
        SELECT _file, _sheet, CAST(e.pos + 2 AS BIGINT) AS _row, e.value AS record FROM lists, LATERAL variant_explode(value) AS e WHERE {kind.format('e.value')} = 'OBJECT'
        UNION ALL SELECT _file, 'root', CAST(2 AS BIGINT), v FROM top WHERE k = 'OBJECT' AND _file NOT IN (SELECT _file FROM keys WHERE {kind.format('value')} = 'ARRAY')"""
    )


def write_cleaned(df: DataFrame, path: str) -> None:
    """Data columns of the cleaned table, in a folder for each file and sheet."""
    df.write.mode("overwrite").partitionBy("_file", "_sheet").parquet(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Add a run's issues, changes or report to a table of runs."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def runs(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The latest runs of a table, newest first; path is that of the reports, which only finished runs have."""
    return spark.read.parquet(path).select("run_id").distinct().orderBy(F.desc("run_id")).limit(limit)


def codebook(spark: SparkSession, path: str) -> DataFrame:
    """(code): the first column of a CSV file, trimmed, without empty values."""
    df = spark.read.csv(path, header=True)
    return df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias("code")).where("code != ''").distinct()


#: The columns that a list of contacts must have.
AGENCY, MAIL = "기관명", "담당자메일"


def _header(names: list[str]) -> list[str]:
    """Column names that were read byte by byte, as UTF-8 with or without a mark in front, else as CP949."""
    for encoding in ("utf-8-sig", "cp949"):
        try:
            return [n.encode("iso-8859-1").decode(encoding) for n in names]
        except UnicodeDecodeError:
            continue
    return names


@F.pandas_udf(StringType())
def _cp949(values: pd.Series) -> pd.Series:
    def text(b: bytes | None) -> str | None:
        try:
            return None if b is None else bytes(b).decode("cp949")
        except UnicodeDecodeError:
            return None

    return values.map(text)


def contacts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(agency, mail) with a well-formed address; of repeated agencies the last row counts, by file name and then by place.

    Files are UTF-8, or CP949 if some value of the file is no UTF-8.  Without a file, or
    without the two columns, there are no contacts; values that neither encoding
    reads are left out.
    """
    none = spark.createDataFrame([], "agency string, mail string")
    try:
        raw = spark.read.csv(path, header=True, encoding="ISO-8859-1")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return none
    names = [n.strip() for n in _header(raw.columns)]
    if not {AGENCY, MAIL} <= set(names):
        return none
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    of = {n: F.encode(F.col(f"`{c}`"), "ISO-8859-1") for n, c in zip(names, raw.columns, strict=True)}
    rows = saved(raw.select(of[AGENCY].alias("a"), of[MAIL].alias("m"), place.alias("at")))
    utf8 = lambda c: F.coalesce(F.is_valid_utf8(F.col(c).cast("string")), F.lit(True))
    files = rows.groupBy(F.col("at.file").alias("_file")).agg(F.bool_and(utf8("a") & utf8("m")).alias("utf8"))
    told = rows.join(files, F.col("at.file") == F.col("_file"))
    read = lambda c: F.when(F.col("utf8"), F.col(c).cast("string")).otherwise(_cp949(F.col(c)))
    clean = told.select(N.strip(read("a")).alias("agency"), N.strip(read("m")).alias("mail"), "at")
    good = clean.where(F.col("mail").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & (F.col("agency") != ""))
    return good.groupBy("agency").agg(F.max_by("mail", "at").alias("mail"))
