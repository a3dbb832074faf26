from paylint.operators import decisions


def test_changes_of_a_row_meet_in_one_aggregation(spark):
    rows = spark.createDataFrame([("f", "s", r, "a", "b") for r in range(2, 6)], "_file string, _sheet string, _row long, x string, y string")
    changes = [("f", "s", 2, "x", "one", 1), ("f", "s", 2, "x", "two", 2), ("f", "s", 2, "y", "z", 1), ("f", "s", 3, "x", "one", 1), ("f", "s", 3, "x", None, 2), ("f", "s", 4, "other", "o", 1)]
    got = decisions.cleaned(rows, spark.createDataFrame(changes, "_file string, _sheet string, _row long, column string, after string, step int"), ["x", "y"])
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [("f", "s", 2, "two", "z"), ("f", "s", 4, "a", "b"), ("f", "s", 5, "a", "b")]
