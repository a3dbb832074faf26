from paylint.operators import cells


def test_rows_of_few_groups_do_not_meet(spark):
    """Quartiles of a few groups go to the rows, however Spark guesses their size."""
    df = spark.range(1000).selectExpr("cast(id % 3 as string) as g", "cast(id * id % 997 as double) as x")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = cells.outlier(df, "x", ["g"], 0.2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and found.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
