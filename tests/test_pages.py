from pathlib import Path

from paylint.operators import pages
from paylint.sources import tables


def test_small_parts_share_files(spark):
    df = spark.range(2000).selectExpr("id * 7 % 2000 as x")
    pages.write_pages(df, path := tables.new_path(spark, "pages"), ["x"], 10)
    assert len(list(Path(path.removeprefix("file://")).rglob("*.parquet"))) < 20
    p = pages.Pages(spark, path, ["x"])
    assert p.total == 2000 and len(p.parts) == 200
    for number, rows in ((0, 50), (7, 33), (39, 50), (40, 50)):
        got = sorted((r["place"], r["x"]) for r in p.page(number, rows).collect())
        assert got == [(i, i) for i in range(number * rows, min(2000, (number + 1) * rows))]
