"""JSON documents put together again after cleaning: other keys, nested objects and wrapped roots stay as they were."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INT, _FLOAT = re.compile(r"^-?[0-9]+$"), re.compile(r"^-?[0-9]+\.[0-9]+$")


def _put(record: str, edits: dict[str, str], amounts: frozenset[str]) -> str:
    """The record with new values in its own types; a column is a key, or a path of keys joined by dots, and passed over if there is none."""
    data = json.loads(record)
    for column, new in edits.items():
        holder, key = data, column
        if column not in data:
            *path, key = column.split(".")
            for part in path:
                holder = holder.get(part) if isinstance(holder, dict) else None
            if not isinstance(holder, dict) or key not in holder:
                continue
        number = isinstance(holder[key], (int, float)) and not isinstance(holder[key], bool)
        if _INT.match(new) and (number or key in amounts):
            holder[key] = int(new)
        elif _FLOAT.match(new) and number:
            holder[key] = float(new)
        else:
            holder[key] = new
    return json.dumps(data, ensure_ascii=False)


def _edited(rows: DataFrame, amounts: list[str]) -> DataFrame:
    """rows (..., text, edits) with the edits in the text. One record at a time goes through Python, and only those with edits."""
    known = frozenset(amounts)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[_put(t, dict(e), known) for t, e in zip(b["text"], b["edits"], strict=True)])

    return rows.mapInPandas(put, rows.schema)


def _shape(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def documents(spark: SparkSession, paths: list[str], name: str = "_metadata.file_name") -> tuple[DataFrame, DataFrame]:
    """Frames and records of JSON files, which together are the files.

    frames (_file, place, before, after): for each key of a file, in the file's order, what
    stands before and after the records of its list, or all of the key's value; the
    file's own brackets have the first and the last place.  records (_file, _sheet, place,
    _row, text): the objects of lists, as text; _row from 2.  An object without lists
    is a record of its own; lists of other things are no records.  Files that are no
    JSON are left out.  name: SQL for what tells files apart, as files of several
    folders may have one name.
    """
    files = spark.read.text(paths, wholetext=True).select(F.expr(name).alias("_file"), "value", F.try_parse_json("value").alias("v")).where("v is not null")
    top = files.withColumn("kind", _shape(F.col("v")))
    plain_list = lambda v: F.schema_of_variant(v).startswith("ARRAY<OBJECT<")
    # the text of a list's elements, in the order and the spelling of the file
    elements = lambda text: F.from_json(text, "array<string>")

    keys = top.where("kind = 'OBJECT'").select("_file", "value", "v", F.posexplode(F.json_object_keys("value")).alias("i", "key"))
    raw = F.from_json("value", "map<string,string>")
    member = keys.select("_file", F.col("key").alias("_sheet"), (F.col("i") + 1).alias("place"), F.element_at(raw, F.col("key")).alias("text"), F.try_variant_get("v", F.lit("$"), "map<string,variant>")[F.col("key")].alias("item"))
    member = member.withColumn("kind", _shape(F.col("item")))
    wrapped = member.groupBy("_file").agg(F.max(F.col("kind") == "ARRAY").alias("lists")).where("not lists").select("_file")
    lists = member.where(plain_list(F.col("item")))
    whole = top.where(plain_list(F.col("v"))).select("_file", F.lit("root").alias("_sheet"), F.lit(1).alias("place"), F.col("value").alias("text"))
    exploded = whole.unionByName(lists.select("_file", "_sheet", "place", "text")).select("_file", "_sheet", "place", F.posexplode(elements(F.col("text"))).alias("at", "text"))
    records = exploded.select("_file", "_sheet", "place", (F.col("at") + 2).cast("long").alias("_row"), "text")
    single = top.join(wrapped, "_file", "left_semi").unionByName(top.where("value is not null and kind = 'OBJECT'").join(member.select("_file").distinct(), "_file", "left_anti"))
    records = records.unionByName(single.select("_file", F.lit("root").alias("_sheet"), F.lit(1).alias("place"), F.lit(2).cast("long").alias("_row"), F.col("value").alias("text")))

    named = F.concat(F.when(F.col("place") > 1, ",").otherwise(""), F.to_json(F.array("_sheet")).substr(F.lit(2), F.length(F.to_json(F.array("_sheet"))) - 2), F.lit(":"))
    listed = plain_list(F.col("item"))
    inner = member.join(wrapped, "_file", "left_anti").select("_file", "place", F.concat(named, F.when(listed, "[").otherwise(F.to_json("item"))).alias("before"), F.when(listed, "]").otherwise("").alias("after"))
    # a list that is no table, and a scalar, stand as they are
    root = top.where("kind <> 'OBJECT'").select("_file", F.lit(1).alias("place"), F.when(plain_list(F.col("v")), "[").otherwise(F.col("value")).alias("before"), F.when(plain_list(F.col("v")), "]").otherwise("").alias("after"))
    braces = member.join(wrapped, "_file", "left_anti").groupBy("_file").agg((F.max("place") + 1).alias("last"))
    ends = braces.select("_file", F.inline(F.array(F.struct(F.lit(0).alias("place"), F.lit("{").alias("before"), F.lit("").alias("after")), F.struct(F.col("last").alias("place"), F.lit("}").alias("before"), F.lit("").alias("after")))))
    return inner.unionByName(root).unionByName(ends), records


def rebuilt(spark: SparkSession, paths: list[str], changed: DataFrame, amounts: list[str] = ("지원금액",), name: str = "_metadata.file_name") -> DataFrame:
    """(_file, place, part, _row, line): the lines of the files with changes in them, in the order of (place, part, _row).

    changed (_file, _sheet, _row, column, after, step), as changes() gives them: the
    last change of a cell counts, one with after null drops the row, but not the
    record that is a whole file.  A number stays one if the new text is a number,
    and an integer in a column of amounts becomes one; all other values are texts.  Columns
    that a record lacks are passed over.
    """
    frames, records = documents(spark, paths, name)
    row = ["_file", "_sheet", "_row"]
    last = changed.groupBy(*row, "column").agg(F.max_by("after", "step").alias("after"), F.bool_or(F.col("after").isNull()).alias("gone"))
    by_row = last.groupBy(*row).agg(F.map_from_entries(F.collect_list(F.when(F.col("after").isNotNull(), F.struct("column", "after")))).alias("edits"), F.bool_or("gone").alias("gone"))
    alone = records.join(frames.select("_file").distinct(), "_file", "left_anti").select("_file").distinct().withColumn("_alone", F.lit(True))
    told = records.join(by_row, row, "left").join(alone, "_file", "left").where("_alone or not coalesce(gone, false)").drop("gone", "_alone")
    told = _edited(told.where("size(edits) > 0"), list(amounts)).unionByName(told.where("edits is null or size(edits) = 0"))
    starts = told.groupBy("_file", "place").agg(F.min("_row").alias("_first"))
    lines = told.join(starts, ["_file", "place"]).select("_file", "place", F.lit(1).alias("part"), "_row", F.concat(F.when(F.col("_row") > F.col("_first"), ",").otherwise(""), "text").alias("line"))
    none = F.lit(None).cast("long").alias("_row")
    edge = lambda part, c: frames.where(F.col(c) != "").select("_file", "place", F.lit(part).alias("part"), none, F.col(c).alias("line"))
    return edge(0, "before").unionByName(lines).unionByName(edge(2, "after"))


def write(lines: DataFrame, path: str) -> None:
    """rebuilt() as one file of JSON in a folder for each file; a file's lines pass one task in order, one at a time."""
    lines.repartition("_file").sortWithinPartitions("_file", "place", "part", "_row").select("_file", F.col("line").alias("value")).write.mode("overwrite").partitionBy("_file").text(path)
