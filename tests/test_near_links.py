from paylint.operators import groups


def test_amounts_without_a_day_make_few_links(spark, monkeypatch):
    """Links grow with bands of amounts, not with pairs of payments."""
    seen = []
    real = groups.components
    monkeypatch.setattr(groups, "components", lambda links: seen.append(links.count()) or real(links))
    rows = [("f", "s", i, "1248100000", "p", "" if i % 2 else "2026-01-05", str(10_000 + i)) for i in range(200)]
    df = spark.createDataFrame(rows, "_file string, _sheet string, _row long, `사업자번호` string, `사업명` string, `지원일자` string, `지원금액` string")
    got = groups.near_payments_open(df, ["사업명"], 10, tol_pct=5.0).collect()
    assert [r["n_rows"] for r in got] == [200] and max(seen) < 20
