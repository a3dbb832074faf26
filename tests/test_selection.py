import random

import numpy as np
from pyspark.sql import functions as F

from paylint.operators import cells, selection


def test_percentiles_equal_numpy_whatever_the_values(spark):
    rng = random.Random(3)
    groups = {
        "even": [float(i) for i in range(997)],
        "same": [5.0] * 800,
        "two": [1.0] * 300 + [2.0] * 301,
        "heavy": [7.5] * 500 + [rng.uniform(-1, 20) for _ in range(600)],
        "wide": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(900)],
        "one": [3.0],
        None: [float(rng.randrange(4)) for _ in range(50)] + [None] * 5,
    }
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, x double").repartition(5)
    qs = [0.0, 0.25, 0.5, 0.731, 1.0]
    for held in (1, 20, 10_000):
        got = {r["g"]: r for r in selection.percentiles(df, ["g"], F.col("x"), qs, held).collect()}
        assert set(got) == set(groups)
        for g, v in groups.items():
            v = [x for x in v if x is not None]
            assert got[g]["n"] == len(v)
            assert np.allclose([got[g][f"q{i}"] for i in range(len(qs))], np.quantile(v, qs), rtol=1e-12), (g, held)
    plan = selection.percentiles(df, ["g"], F.col("x"), qs)._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "median(" not in plan
    assert selection.percentiles(df.where("false"), ["g"], F.col("x"), qs).count() == 0


def test_outliers_of_small_groups(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 1.0), ("b", 2.0), ("b", 900.0)] + [("c", float(x)) for x in (10, 11, 12, 13, -50)]
    got = cells.outlier(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], times=4.0).collect()
    assert {(r["g"], r["x"], r["outlier"]) for r in got} == {("a", 100.0, "mean"), ("c", -50.0, "low")} | {("c", x, "mean") for x in ()}
