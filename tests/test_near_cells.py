import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from paylint.operators import groups

SCHEMA = "_file string, _sheet string, _row long, `사업명` string, `지원일자` string, `지원금액` string"


def _table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("사업자번호", F.lit("1248100000"))


def _links(monkeypatch):
    seen = []
    real = groups.components
    monkeypatch.setattr(groups, "components", lambda links: seen.append(links.where("a != b").distinct().count()) or real(links))
    return seen


def test_like_amounts_are_chained_without_links(spark, monkeypatch):
    """Amounts of a band make one chain however long, and all links are worked out in one go."""
    seen = _links(monkeypatch)
    rows = [("f", "s", i, "p", (date(2025, 1, 1) + timedelta(days=10 * i)).isoformat(), str(10_000 + i)) for i in range(60)]
    got = groups.near_payments_open(_table(spark, rows), ["사업명"], 10, tol_pct=5.0).collect()
    assert [(r["n_rows"], str(r["first_day"]), str(r["last_day"])) for r in got] == [(60, "2025-01-01", "2026-08-14")] and seen == [0]


@pytest.mark.parametrize("step", [10, 11])
def test_bands_meet_at_the_limit(spark, step):
    """Amounts of different bands, exactly 5 percent apart, a day before, after, or one day too far."""
    rows = [("f", "s", i, "p", (date(2025, 1, 1) + timedelta(days=step * i)).isoformat(), amount) for i, amount in enumerate(["9500", "10000", "9500", "9499", "-9500", "-10000", "0", "1"])]
    got = groups.near_payments_open(_table(spark, rows), ["사업명"], 10, tol_pct=5.0).collect()
    assert sorted(r["n_rows"] for r in got) == ([2, 4] if step == 10 else [])


def test_cells_against_all_pairs(spark):
    """Many amounts and days, texts of one value written in two ways, against a comparison of all pairs."""
    rng = random.Random(5)
    days = [date(2025, 1, 1) + timedelta(days=rng.randrange(1500)) for _ in range(400)]
    amounts = [rng.randrange(1000, 60_000) for _ in range(400)]
    rows = [(f"f{i % 2}", "s", i, "pq"[i % 2], d.isoformat() if i % 3 else d.strftime("%Y.%m.%d"), str(a) if i % 5 else f"{a}원") for i, (d, a) in enumerate(zip(days, amounts, strict=True))]
    label = list(range(400))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(400):
        for j in range(i):
            if rows[i][3] == rows[j][3] and abs((days[i] - days[j]).days) <= 25 and abs(amounts[i] - amounts[j]) * 100 <= 8 * max(amounts[i], amounts[j]):
                label[top(i)] = top(j)
    found = {}
    for i in range(400):
        found.setdefault(top(i), []).append(i)
    wanted = [g for g in found.values() if len(g) > 1]
    df = _table(spark, rows)
    got = groups.near_payments_open(df, ["사업명"], 25, tol_pct=8.0).collect()
    assert sorted((r["사업명"], r["n_rows"], r["first_day"], r["last_day"]) for r in got) == sorted((rows[g[0]][3], len(g), min(days[i] for i in g), max(days[i] for i in g)) for g in wanted) and len(wanted) > 20
    members = {}
    for r in groups.near_payment_rows(df, ["사업명"], ["사업명", "지원일자"], 25, tol_pct=8.0).collect():
        members.setdefault(r["group_id"], []).append(r["_row"])
    assert sorted(sorted(m) for m in members.values()) == sorted(sorted(g) for g in wanted)


@pytest.mark.parametrize("tol", [0.0, 5.0])
def test_a_payment_without_day_and_amount_joins_its_group(spark, tol):
    rows = [("f", "s", i + 20 * (p == "q"), p, (date(2025, 1, 1) + timedelta(days=50 * i)).isoformat(), str(10_000 * (i + 1))) for i in range(4) for p in "pq"]
    rows += [("h", "s", 9, "p", "", ""), ("f", "s", 10, "q", "", "20000"), ("f", "s", 11, "q", "2025-01-05", "")]
    df = _table(spark, rows)
    got = groups.near_payments_open(df, ["사업명"], 10, tol_pct=tol).collect()
    assert sorted((r["사업명"], r["n_rows"], str(r["first_day"]), str(r["last_day"]), r["several_files"]) for r in got) == [("p", 5, "2025-01-01", "2025-05-31", True), ("q", 4, "2025-01-01", "2025-02-20", False)]
    members = sorted((r["kind"], r["_row"]) for r in groups.near_payment_rows(df, ["사업명"], ["사업명"], 10, tol_pct=tol).collect())
    assert members == sorted([("several_files", i) for i in (0, 1, 2, 3, 9)] + [("same_rows", i) for i in (20, 21, 10, 11)])
