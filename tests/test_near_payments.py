import random
from datetime import date, timedelta

import pytest

from paylint.operators import groups

SCHEMA = "_file string, _sheet string, _row long, `사업자번호` string, `사업명` string, `지원일자` string, `지원금액` string"


def plain(rows, days, tol):
    """Components of the payments of each program, every pair compared."""
    label = list(range(len(rows)))

    def fits(x, y):
        (_, _, _, _, p, d, a), (_, _, _, _, q, e, b) = x, y
        if p != q or (d and e and abs((date.fromisoformat(d) - date.fromisoformat(e)).days) > days):
            return False
        if a == "" or b == "":
            return True
        a, b = int(a), int(b)
        return a == b if a == 0 or b == 0 else abs(a - b) * 100 <= tol * max(abs(a), abs(b))

    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and fits(rows[i], rows[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    out = {}
    for r, k in zip(rows, label):
        out.setdefault(k, []).append(r)
    return [g for g in out.values() if len(g) > 1]


@pytest.mark.parametrize(("tol", "gaps"), [(5.0, False), (5.0, True), (0.0, True), (30.0, False)])
def test_tolerance(spark, tol, gaps):
    rng = random.Random(int(tol) + gaps)
    rows = []
    for i in range(90):
        day = (date(2026, 1, 1) + timedelta(days=rng.randrange(400))).isoformat()
        amount = str(rng.choice([0, 100, 95, 94, 1000, 1040, 1090, -500, -510, rng.randrange(1, 5000)]))
        if gaps and i % 30 == 0:
            day = ""
        if gaps and i % 25 == 1:
            amount = ""
        rows.append((rng.choice("ab"), "s", i, f"12481{i % 3:05d}", f"p{i % 4 if not gaps else i % 9}", day, amount))
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = plain(rows, 10, tol)
    got = groups.near_payments_open(df, ["사업명"], 10, tol_pct=tol)
    assert sorted((r["사업명"], r["n_rows"], r["several_files"]) for r in got.collect()) == sorted((g[0][4], len(g), len({r[0] for r in g}) > 1) for g in wanted)
    found = {}
    columns = ["사업자번호", "사업명", "지원일자", "지원금액"]
    for r in groups.near_payment_rows(df, ["사업명"], columns, 10, tol_pct=tol).collect():
        found.setdefault(r["group_id"], []).append((r["_row"], r["kind"], r["n_rows"]))

    def kind(g):
        if len({r[0] for r in g}) > 1:
            return "several_files"
        return "same_rows" if all(sum(x[3:] == y[3:] for y in g) > 1 for x in g) else "double"

    assert sorted(sorted(x) for x in found.values()) == sorted(sorted((r[2], kind(g), len(g)) for r in g) for g in wanted) and wanted
