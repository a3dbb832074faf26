from pyspark.sql import functions as F

from paylint.functions import normalize as N


def test_a_cell_is_read_once_for_its_check_digit(spark):
    """Filters are pushed below projections and take the cell's expression with them as often as it is named."""
    made = spark.range(1).select(F.concat(F.lit("124-81-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("c"))
    plan = made.where(N.check_digit_ok(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lpad") <= 2 * plan.count("Filter") and plan.count("substring") == 0


def test_numbers_and_spaces_in_any_form(spark):
    cells = ["124-81-00998", "1248100998", "１２４-81-00998", " 1248100998", "124-81-0099", "abc", "", None, "0000000000", "124-81-00997"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    ok = [r[0] for r in df.select(N.check_digit_ok(F.col("c"))).collect()]
    assert ok == [True, True, True, True, None, None, None, None, True, False]
    spaces = ["a b", " a", "a ", "a  b", "a\tb", "a\n", "　a", "é x", "한 글", "", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in spaces], "c string").select(N.squeeze(F.col("c"))).collect()]
    assert got == [None, "a", "a", "a b", "a b", "a", "a", None, None, None, None]
