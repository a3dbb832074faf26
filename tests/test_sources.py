import json
import re

import pytest

from paylint.sources import json_documents, publication, tables

FILES = {
    "a": {"meta": {"by": "x", "n": 1.5, "none": None}, "rows": [{"b": 1, "a": {"c": "2", "d": [1, {"e": 2}]}, "지원금액": "7"}, {"b": 2.5}, {"b": "t", "q\"uote": 'say "x"\n'}], "empty": [], "codes": [1, "2"], "more": [{"k": True}]},
    "b": [{"x": "1"}, {"x": 2, "y.z": 3, "y": {"z": 4}}, {"x": None}],
    "c": {"only": 1, "deep": {"er": "v"}},
    "d": [1, 2],
    "e": "text",
    "f": {},
}


def folder(tmp_path):
    paths = []
    for name, data in FILES.items():
        paths.append(str(tmp_path / f"{name}.json"))
        (tmp_path / f"{name}.json").write_text(json.dumps(data, ensure_ascii=False, indent=1), encoding="utf-8")
    (tmp_path / "g.json").write_text("{broken", encoding="utf-8")
    return [*paths, str(tmp_path / "g.json")]


CHANGED = "_file string, _sheet string, _row long, column string, after string, step int"


def written(spark, lines, tmp_path):
    json_documents.write(lines, out := str(tmp_path / "out"))
    rows = spark.read.text(out, wholetext=True).collect()
    return {r["_file"].split(".")[0]: json.loads(r["value"]) for r in rows}


def test_documents_without_changes_are_the_same(spark, tmp_path):
    lines = json_documents.rebuilt(spark, folder(tmp_path), spark.createDataFrame([], CHANGED))
    got = written(spark, lines, tmp_path)
    assert got == FILES
    assert list(got["a"]) == list(FILES["a"]) and list(got["a"]["rows"][0]) == ["b", "a", "지원금액"]


def test_changes_keep_types_paths_and_dropped_rows(spark, tmp_path):
    changes = [
        ("a.json", "rows", 2, "a.c", "9", 1), ("a.json", "rows", 2, "b", "10", 1), ("a.json", "rows", 2, "b", "11", 2), ("a.json", "rows", 2, "지원금액", "1000", 1), ("a.json", "rows", 2, "a.missing", "0", 1),
        ("a.json", "rows", 3, "b", "2.75", 1), ("a.json", "rows", 4, "b", None, 1), ("a.json", "more", 2, "k", "1", 1), ("a.json", "more", 2, "k", None, 2),
        ("b.json", "root", 2, "x", None, 1), ("b.json", "root", 3, "y.z", "5", 1), ("b.json", "root", 3, "x", "two", 1), ("c.json", "root", 2, "deep.er", "1", 1), ("c.json", "root", 2, "only", None, 2),
    ]
    got = written(spark, json_documents.rebuilt(spark, folder(tmp_path), spark.createDataFrame(changes, CHANGED)), tmp_path)
    want = json.loads(json.dumps(FILES))
    want["a"]["rows"] = [{"b": 11, "a": {"c": "9", "d": [1, {"e": 2}]}, "지원금액": 1000}, {"b": 2.75}]
    want["a"]["more"] = []
    want["b"] = [{"x": "two", "y.z": 5, "y": {"z": 4}}, {"x": None}]
    want["c"]["deep"]["er"] = "1"
    assert got == want


def test_runs_are_seen_when_they_are_committed(spark, tmp_path):
    store = str(tmp_path / "store")
    issues = spark.createDataFrame([("i1", "R", "2", "v"), ("i2", "R", "x", "v"), (None, "R", "3", "v"), ("i3", "R", "4", "")], "issue_id string, rule_id string, _row string, value string")
    assert publication.runs(spark, store).count() == 0
    broken = publication.Run(spark, store, "r1")
    broken.write("issues", issues)
    assert publication.runs(spark, store).count() == 0 and publication.table(spark, store, "issues").count() == 0
    again = publication.Run(spark, store, "r1")
    again.write("issues", issues)
    again.write("groups", spark.createDataFrame([("g1", "m"), ("g2", "m")], "group_id string, metric string"))
    again.commit()
    twice = publication.Run(spark, store, "r1")
    twice.write("issues", issues)
    twice.commit()
    later = publication.Run(spark, store, "r2")
    later.write("issues", issues.limit(1))
    later.commit()
    assert [r["run_id"] for r in publication.runs(spark, store).collect()] == ["r2", "r1"]
    assert [r["run_id"] for r in publication.runs(spark, store, 1).collect()] == ["r2"]
    assert publication.table(spark, store, "issues", "r1").count() == 4
    assert sorted((r["issue_id"], r["_row"], r["value"]) for r in publication.loaded_issues(spark, store, "r1").collect()) == [("i1", 2, "v"), ("i3", 4, None)]
    log = spark.createDataFrame([("g1", "ok", 1), ("g1", "request", 2), ("g2", "ok", 3)], "group_id string, disposition string, seq int")
    assert sorted((r["group_id"], r["disposition"]) for r in publication.groups_with_dispositions(spark, store, "r1", log).collect()) == [("g1", "request"), ("g2", "ok")]
    assert publication.table(spark, store, "groups").count() == 2


def test_new_paths_need_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        tables.new_path(Spark(), "x")


def test_large_arrays_are_cut_at_records_in_any_split(spark, tmp_path):
    from pyspark.sql import functions as F

    from paylint.sources import json_arrays

    nasty = ['} ] [ { , "', "\\", '\\"}', "{\n}", "é}]日本", "", "[]"]
    files = {
        "one.json": json.dumps([{"i": i, "s": nasty[i % 7] * (i % 5), "o": {"l": [{"x": i}, [], {}], "}": "]"}, "n": None} for i in range(300)], ensure_ascii=False),
        "two.json": json.dumps([{"i": i, "s": nasty[i % 7], "o": {}} for i in range(120)], indent=3),
        "none.json": "[]",
        "last.json": ' [ {"i": 1 , "s": "}"} ]\n',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    paths = [str(tmp_path / n) for n in files]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = spark.read.text(paths, lineSep="}")
        assert read.select("_metadata.file_block_start").distinct().count() > 10
        got = json_arrays.load_json_array(spark, paths).select("_file", "_row", F.col("record").cast("string").alias("t")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r["_file"], r["_row"]): json.loads(r["t"]) for r in got} == {(n, i + 2): x for n, t in files.items() for i, x in enumerate(json.loads(t))}
    assert len(got) == 421


def test_pages_read_their_part_alone(spark, tmp_path):
    from paylint.operators import pages

    rows = [(i * 7919 % 1000, f"r{i}", None if i % 9 == 0 else i % 4) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, name string, g int").repartition(4)
    pages.write_pages(df, str(tmp_path / "p"), ["g", "k"], part_rows=90)
    index = pages.Pages(spark, str(tmp_path / "p"), ["g", "k"])
    want = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert index.total == 1000 and len(index.parts) > 8
    for number, size in ((0, 50), (7, 50), (19, 50), (20, 50), (3, 300), (0, 5000)):
        got = index.page(number, size).orderBy("place").collect()
        assert [(r["k"], r["name"], r["g"]) for r in got] == want[number * size : (number + 1) * size]
        assert [r["place"] for r in got] == list(range(number * size, min(1000, (number + 1) * size)))
    plan = index.page(7, 50)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part#", plan)
    pages.write_pages(df.limit(0), str(tmp_path / "none"), ["k"])


def test_contacts_in_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("기관명,부서,담당자메일\n시군 가,x,a@b.kr\n시군 나,x,bad\n 시군 다 ,x, d@e.kr \n,x,n@n.kr\n".encode("cp949"))
    (tmp_path / "b.csv").write_bytes("기관명,부서,담당자메일\n시군 가,x,later@b.kr\n시군 가,x,last@b.kr\n시군 라,x,r@s.kr\n".encode("utf-8-sig"))
    (tmp_path / "c.csv").write_text("name,mail\na,b@c.d\n", encoding="utf-8")
    got = lambda p: {r["agency"]: r["mail"] for r in tables.contacts(spark, p).collect()}
    assert got(str(tmp_path / "a.csv")) == {"시군 가": "a@b.kr", "시군 다": "d@e.kr"}
    assert got(str(tmp_path / "b.csv")) == {"시군 가": "last@b.kr", "시군 라": "r@s.kr"}
    assert got(str(tmp_path / "c.csv")) == got(str(tmp_path / "none.csv")) == {}


def test_integers_of_a_json_schema(spark):
    from pyspark.sql import functions as F

    from paylint.operators import strict

    given = {"1": None, "1.0": None, "-3.000": None, "1e2": None, "12345678901234567890123": None, "1" * 60: None, "1.5": "$: not integer", "9007199254740993.5": "$: not integer", "1.5e0": "$: not integer", '"1"': "$: not integer", "true": "$: not integer", "": None}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    got = {r["t"]: r["m"] for r in df.select("t", strict.json_violation(F.col("t"), {"type": "integer"}).alias("m")).collect()}
    assert got == given
