import random

from pyspark.sql import functions as F

from paylint.operators import fuzzy


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def made(n, seed):
    rng = random.Random(seed)
    names = ["(주)가나다 상사", "한빛 전자", "Alpha Works", "beta trading", ""]
    out = []
    for i in range(n):
        a, b, c = (rng.choice(names) for _ in range(3))
        if out and rng.random() < 0.5:
            a, b, c = rng.choice(out)[3:6]
            a = a[:-1] + rng.choice("xyz") if a and rng.random() < 0.7 else a
        out.append((rng.choice("fg"), "s", i, a, b, c if rng.random() < 0.9 else None))
    return out


def test_lcs(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abc가") for _ in range(rng.randrange(12))), "".join(rng.choice("abc가") for _ in range(rng.randrange(12)))) for _ in range(300)]
    got = spark.createDataFrame(rows, "a string, b string").select(fuzzy.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [round(r["r"], 9) for r in got] == [round(ratio(a, b), 9) for a, b in rows]


def test_near_duplicate_rows(spark):
    """As a loop over pairs in row order reports them."""
    rows = made(70, 2)
    reported = {}
    for file in "fg":
        mine = [r for r in rows if r[0] == file]
        for i, x in enumerate(mine):
            for y in mine[i + 1 :]:
                if (file, x[2]) in reported or (file, y[2]) in reported:
                    continue
                pairs = [(p or "", q or "") for p, q in zip(x[3:], y[3:]) if (p or "").strip() or (q or "").strip()]
                if len(pairs) >= 2 and sum(ratio(p, q) for p, q in pairs) / len(pairs) >= 0.85:
                    reported[file, y[2]] = x[2]
    df = spark.createDataFrame(rows, "_file string, _sheet string, _row int, a string, b string, c string")
    got = {(r["_file"], r["_row"]): r["like_row"] for r in fuzzy.near_duplicate_rows(df, ["a", "b", "c"]).collect()}
    assert got == reported and len(got) > 5
    issues = fuzzy.near_duplicate_issues(df, ["a", "b", "c"]).collect()
    assert {r["rule_id"] for r in issues} == {"NEAR_DUPLICATE"} and all(r["value"].startswith("유사도 ") for r in issues)
    blocked = fuzzy.near_duplicate_rows(df, ["a", "b", "c"], block=["b"]).collect()
    assert 0 < len(blocked) <= len(got)


def test_nearest_codes(spark):
    codes = ["BIZ-001", "BIZ-002", "BIZ-010", "EXP-1", "RND-2026"]
    df = spark.createDataFrame([(v,) for v in ["BIZ-0O1", "EXP1", "BIZ-001", "", None, "RND2026"]], "x string")
    got = fuzzy.nearest_codes(df, "x", spark.createDataFrame(list(zip(codes, range(5))), "code string, ord int"), 2).collect()
    wanted = {(v, k + 1, c) for v in ["BIZ-0O1", "EXP1", "RND2026"] for k, c in enumerate(sorted(codes, key=lambda c: (-ratio(v, c), codes.index(c)))[:2])}
    assert {(r["value"], r["rank"], r["code"]) for r in got} == wanted


def test_nearest_codes_of_many_equal_a_loop_and_compare_few_pairs(spark):
    rng = random.Random(5)
    syllables = ["가", "나", "다", "BIZ", "EXP", "01", "9", "-", "x", "qu", "😀"]
    codes = list(dict.fromkeys("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 7))) for _ in range(150)))
    values = list(dict.fromkeys([c[:-1] + rng.choice("ab가") for c in codes[:60]] + ["#", "zz", codes[0]]))
    df = spark.createDataFrame([(v,) for v in values], "x string")
    book = spark.createDataFrame(list(zip(codes, range(len(codes)))), "code string, ord int")
    for n in (1, 4):
        got = {(r["value"], r["rank"], r["code"], round(r["score"], 9)) for r in fuzzy.nearest_codes(df, "x", book, n).collect()}
        unknown = [v for v in values if v not in codes]
        wanted = {(v, k + 1, c, round(ratio(v, c), 9)) for v in unknown for k, c in enumerate(sorted(codes, key=lambda c: (-ratio(v, c), codes.index(c)))[:n])}
        assert got == wanted
    others = spark.createDataFrame([(v,) for v in unknown], "value string")
    assert fuzzy.compared_codes(others, book, 1).count() < 0.25 * len(unknown) * len(codes)


def test_candidates_lose_no_pair_and_are_no_product(spark):
    rows = [(f, s, i, a, b, c or "  ") for f, s, i, a, b, c in made(90, 7)]
    df = spark.createDataFrame(rows, "_file string, _sheet string, _row int, v0 string, v1 string, v2 string")
    for t in (0.6, 0.85, 1.0):
        found = {(r["_file"], r["a"], r["b"]) for r in fuzzy._candidates(df, ["v0", "v1", "v2"], t, ["_file", "_sheet"]).collect()}
        for i, x in enumerate(rows):
            for y in rows[i + 1 :]:
                pairs = [(p, q) for p, q in zip(x[3:], y[3:]) if p.strip() or q.strip()]
                if x[0] == y[0] and len(pairs) >= 2 and sum(ratio(p, q) for p, q in pairs) / len(pairs) >= t:
                    assert (x[0], x[2], y[2]) in found
    plan = fuzzy.near_duplicate_rows(df, ["v0", "v1", "v2"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
