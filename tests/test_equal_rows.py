from paylint.operators import fuzzy


def test_equal_rows_stand_as_one(spark, monkeypatch):
    """Pairs grow with different rows, not with copies of one."""
    seen = []
    real = fuzzy._reported
    monkeypatch.setattr(fuzzy, "_reported", lambda edges: seen.append(edges.count()) or real(edges))
    rows = [("f", "s", i, "large ring 1" if i % 2 else "large ring 2", "size 5") for i in range(200)] + [("f", "s", 300, "", "size 5"), ("f", "s", 301, "", "size 5")]
    df = spark.createDataFrame(rows, "_file string, _sheet string, _row int, a string, b string")
    got = {r["_row"]: (r["like_row"], round(r["score"], 4)) for r in fuzzy.near_duplicate_rows(df, ["a", "b"], 0.9).collect()}
    assert got == {i: (0, 0.9583 if i % 2 else 1.0) for i in range(1, 200)} and seen == [1]
