from pathlib import Path

from paylint.operators import pages
from paylint.sources import tables


def test_ranges_have_folders_and_pages_cross_them(spark, monkeypatch):
    monkeypatch.setattr(pages, "PART_ROWS", 60)
    df = spark.range(500).selectExpr("id * 7 % 500 as x")
    pages.write_pages(df, path := tables.new_path(spark, "pages"), ["x"], 20)
    folders = sorted(d.name for d in Path(path.removeprefix("file://")).glob("part=*"))
    assert 2 < len(folders) <= 9 and folders[0] == "part=0"
    # rows of a file are in order, so a part is found by the file's statistics
    for f in folders:
        got = [r["x"] for r in spark.read.parquet(f"{path}/{f}").coalesce(1).collect()]
        assert got == sorted(got)
    p = pages.Pages(spark, path, ["x"])
    assert p.total == 500
    for number, rows in ((0, 50), (1, 70), (2, 70), (6, 75), (0, 500)):
        got = p.page(number, rows)
        assert got.columns == ["x", "place"]
        assert sorted((r["place"], r["x"]) for r in got.collect()) == [(i, i) for i in range(number * rows, min(500, (number + 1) * rows))]


def test_no_rows_have_no_pages(spark):
    pages.write_pages(spark.range(0), path := tables.new_path(spark, "pages"), ["id"], 20)
    p = pages.Pages(spark, path, ["id"])
    assert p.total == 0 and p.page(0).columns == ["id", "place"] and p.page(0).collect() == []
