from paylint.plans import exports, review

SF = "/root/testdata/sf0.001"


def test_marks_and_changes_do_not_run_the_checks_again(spark):
    for found in (review._marked(spark, SF), exports._details(spark, SF)[0], exports._g1_cells(spark, SF)):
        assert "orders.parquet" not in found._jdf.queryExecution().toString()
