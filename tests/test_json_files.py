import json

from paylint.plans import exports
from paylint.sources import tables


def test_small_documents_are_written_by_many_tasks_in_one_folder(spark, tmp_path):
    docs = spark.range(100).selectExpr("id AS part", "concat('[', id, ']') AS value")
    files = spark.read.text(exports._json_files(spark, docs), wholetext=True).selectExpr("value", "_metadata.file_path AS path").collect()
    assert sorted(json.loads(r["value"])[0] for r in files) == list(range(100))
    folders, tasks = {r["path"].rpartition("/")[0] for r in files}, {r["path"].rpartition("/")[2][:10] for r in files}
    assert len({r["path"] for r in files}) == 100 and len(folders) == 1 and len(tasks) > 4


def test_files_are_read_once(spark, tmp_path):
    for name, text in (("a", '{"x": [], "y": [1], "z": [{"k": 1}], "(file)": []}'), ("b", "{}"), ("c", "null"), ("d", "[]"), ("e", "[[1]]"), ("f", "{broken"), ("g", "7"), ("h", '[{"k": 1}]')):
        (tmp_path / f"{name}.json").write_text(text)
    got = tables.unsupported_json(spark, [str(tmp_path)])
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    empty, other, neither = "empty list", "list of other things than objects", "neither list nor object"
    wanted = [("a.json", "(file)", empty), ("a.json", "x", empty), ("a.json", "y", other), ("c.json", "(file)", neither), ("d.json", "(file)", empty), ("e.json", "(file)", other), ("f.json", "(file)", "not JSON"), ("g.json", "(file)", neither)]
    assert sorted(map(tuple, got.collect())) == wanted
