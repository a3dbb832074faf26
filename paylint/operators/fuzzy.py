"""Similar texts: the indel ratio, near-duplicate rows, nearest codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from paylint.functions import normalize as N
from paylint.operators.cells import KEYS
from paylint.operators.selection import few
from paylint.sources.tables import saved

#: Values that are compared, fewer leave a pair of rows alone.
LEAST_COLUMNS = 2
#: Tables of at most this many codes are broadcast.
BROADCAST_CODES = 20_000


def _lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence, by the bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.pandas_udf(LongType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs(x, y) for x, y in zip(a, b, strict=True)])


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (length of a + length of b): 1 for equal texts, also for two empty ones. The one place where a row needs Python."""
    return F.when(a == b, F.lit(1.0)).otherwise(2.0 * lcs(a, b) / (F.length(a) + F.length(b)))


def _letters(c: Column) -> Column:
    """The characters of a text, each with how often it has come up so far: two texts share as many of them as a common subsequence can have, or more."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return N.let(chars, lambda all_: F.transform(all_, lambda x, i: F.concat(x, F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda y: y == x)).cast("string"))))


def _candidates(rows: DataFrame, columns: list[str], threshold: float, keys: list[str], least: int = LEAST_COLUMNS) -> DataFrame:
    """(keys, a, b): pairs of rows a < b that may be as alike as the threshold; none that is gets lost.

    Letters of a row, from its rarest on, are its prefix until what is left cannot
    reach the threshold: with s letters left of a text of l, no ratio exceeds 2s / (l
    + s).  The rarest letter that two such rows share lies in the prefixes of both, so
    rows meet by equal letters of equal columns only.
    """
    used = sum((F.coalesce(F.trim(f"`{c}`") != "", F.lit(False)).cast("int") for c in columns), F.lit(0))
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.length(f"`{c}`").alias("l"), _letters(F.col(f"`{c}`")).alias("letters")) for i, c in enumerate(columns)))).alias("x")
    letters = rows.select(*keys, "_row", F.greatest(used, F.lit(least)).alias("n"), cells).select(*keys, "_row", "n", "x.c", "x.l", F.size("x.letters").alias("s"), F.explode("x.letters").alias("letter"))
    letters = saved(letters)
    token = [*keys, "c", "letter"]
    often = letters.groupBy(*token).agg(F.count(F.lit(1)).alias("often"))
    named = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"o.`{k}`")) for k in token]
    ranked = letters.alias("l").join(often.alias("o"), named).select("l.*", "o.often")
    order = [F.col("often"), F.col("c"), F.col("letter")]
    left = F.col("s") - F.row_number().over(Window.partitionBy(*keys, "_row", "c").orderBy(*order)) + 1
    most = lambda s: 2.0 * s / (F.col("l") + s)
    gone = ranked.withColumn("left", left).withColumn("loss", most(F.col("left")) - most(F.col("left") - 1))
    by_row = Window.partitionBy(*keys, "_row").orderBy(*order)
    total = F.sum("loss").over(Window.partitionBy(*keys, "_row"))
    prefix = gone.withColumn("before", F.sum("loss").over(by_row.rowsBetween(Window.unboundedPreceding, -1))).withColumn("rest", total - F.coalesce("before", F.lit(0.0)))
    prefix = saved(prefix.where(F.col("rest") >= threshold * F.col("n") - 1e-9).select(*token, "_row"))
    same = F.expr(" and ".join(f"x.`{k}` <=> y.`{k}`" for k in token))
    return prefix.alias("x").join(prefix.alias("y"), same).where("x._row < y._row").selectExpr(*(f"x.`{k}` as `{k}`" for k in keys), "x._row as a", "y._row as b").distinct()


def _alike(rows: DataFrame, columns: list[str], least: float, keys: list[str]) -> DataFrame:
    """(p, q, s): values of a column of equal keys that are as alike as `least` or both blank, in both orders, and each with itself; each pair of texts is compared once."""
    values = saved(rows.select(*keys, F.posexplode(F.array(*columns)).alias("at", "v")).distinct())
    met = _candidates(values.select(*keys, "at", "v", F.col("v").alias("_row")), ["v"], least, [*keys, "at"], 1).select("a", "b").distinct()
    most = 2.0 * F.size(F.array_intersect(_letters(F.col("a")), _letters(F.col("b")))) / (F.length("a") + F.length("b"))
    near = saved(met.where(most >= least).withColumn("s", indel_ratio(F.col("a"), F.col("b"))).where(F.col("s") >= least))
    blanks = values.where("trim(v) = ''").select("v", F.lit(0).alias("_k")).distinct()
    blank = blanks.join(blanks.withColumnRenamed("v", "w"), "_k").where("v != w").select("v", "w", F.lit(0.0))
    out = near.select("a", "b", "s").union(near.select("b", "a", "s")).union(blank).union(values.select("v", "v", F.lit(1.0)).distinct())
    # the longest scores of a pair count: blanks may be alike by their letters too
    return saved(out.toDF("p", "q", "s").groupBy("p", "q").agg(F.max("s").alias("s")))


def _edges_of_values(rows: DataFrame, columns: list[str], threshold: float, keys: list[str], least: float) -> DataFrame:
    """(_file, _sheet, a, b, score): pairs of rows a < b as alike as the threshold, where each column that counts must reach `least` for that.

    Rows meet by like values of the column that makes the fewest pairs.
    """
    alike = _alike(rows, columns, least, keys)
    same = lambda x, y: F.expr(" and ".join(f"{x}.`{k}` <=> {y}.`{k}`" for k in keys))
    costs = []
    for c in columns:
        n = saved(rows.groupBy(*keys, F.col(c).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n")))
        met = n.alias("x").join(few(alike).alias("w"), F.expr("x.v = w.p")).join(n.alias("y"), same("x", "y") & F.expr("w.q = y.v"))
        costs.append(met.agg(F.sum(F.expr("x.n * y.n"))).first()[0] or 0.0)
    first = costs.index(min(costs))
    pairs = rows.alias("x").join(few(alike).alias(f"w{first}"), F.expr(f"x.{columns[first]} = w{first}.p")).join(rows.alias("y"), same("x", "y") & F.expr(f"w{first}.q = y.{columns[first]}")).where("x._row < y._row")
    for i, c in enumerate(columns):
        if i != first:
            pairs = pairs.join(few(alike).alias(f"w{i}"), F.expr(f"x.{c} = w{i}.p and y.{c} = w{i}.q"))
    used = [(F.trim(f"x.{c}") != "") | (F.trim(f"y.{c}") != "") for c in columns]
    n = sum((u.cast("int") for u in used), F.lit(0))
    total = sum((F.when(u, F.col(f"w{i}.s")).otherwise(0.0) for i, u in enumerate(used)), F.lit(0.0))
    scored = pairs.select(F.col("x._file").alias("_file"), F.col("x._sheet").alias("_sheet"), F.col("x._row").alias("a"), F.col("y._row").alias("b"), n.alias("_n"), (total / n).alias("score"))
    return scored.where((F.col("_n") >= LEAST_COLUMNS) & (F.col("score") >= threshold - 1e-12)).drop("_n")


def near_duplicate_rows(df: DataFrame, columns: list[str], threshold: float = 0.85, block: list[str] | None = None) -> DataFrame:
    """(_file, _sheet, _row, like_row, score): rows that are like an earlier row of their file and sheet, and the earliest such row.

    Two rows are as alike as the mean indel ratio of the columns where either is not
    blank, of which there must be LEAST_COLUMNS.  Rows are looked at in order and a
    reported row is like no later one: rows without an earlier undecided neighbour
    are kept, their neighbours reported, and so on until all are decided.

    Rows with equal cells stand as one, their first.  If every column must be alike for two
    rows to be, the different values of columns are compared, see _edges_of_values().  Else
    rows meet if they share a rare letter, see _candidates(), which loses no pair; then
    lengths and letters bound a pair's score before its texts are compared.  block:
    columns that must be equal, besides, for two rows to be compared.  Null cells
    are empty.
    """
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(f"v{i}") for i, c in enumerate(columns)]
    keys = [F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(block or [])]
    rows = saved(df.select("_file", "_sheet", "_row", *cells, *keys))
    by, texts = ["_file", "_sheet", *(f"b{i}" for i in range(len(keys)))], [f"v{i}" for i in range(len(columns))]
    # equal rows are alike if enough of their columns are not blank
    n_used = sum(((F.trim(t) != "").cast("int") for t in texts), F.lit(0))
    every, alone = rows, F.when(n_used < LEAST_COLUMNS, F.col("_row"))
    rows = saved(every.groupBy(*by, *texts, alone.alias("_alone")).agg(F.min("_row").alias("_row")).drop("_alone"))
    least = threshold * len(columns) - (len(columns) - 1) - 1e-9
    edges = _edges_of_values(rows, texts, threshold, by, least) if least > 0.01 else _edges_of_letters(rows, columns, threshold, by)
    found = _reported(saved(edges))
    on = F.expr(" and ".join(f"e.`{c}` <=> r.`{c}`" for c in [*by, *texts]))
    later = every.where(n_used >= LEAST_COLUMNS).alias("e").join(rows.alias("r"), on).where("e._row > r._row").select("e._file", "e._sheet", "e._row", F.col("r._row").alias("_first"))
    known = found.select(F.col("_file").alias("_f"), F.col("_sheet").alias("_s"), F.col("_row").alias("_r"), "like_row", "score")
    more = later.join(known, F.expr("_file = _f and _sheet = _s and _first = _r"), "left").select("_file", "_sheet", "_row", F.coalesce("like_row", "_first").alias("like_row"), F.coalesce("score", F.lit(1.0)).alias("score"))
    return found.unionByName(more)


def _edges_of_letters(rows: DataFrame, columns: list[str], threshold: float, by: list[str]) -> DataFrame:
    """(_file, _sheet, a, b, score): pairs of rows a < b as alike as the threshold."""
    met = _candidates(rows, [f"v{i}" for i in range(len(columns))], threshold, by)
    met = met.select(F.col("_file").alias("_f"), F.col("_sheet").alias("_s"), "a", "b")
    of = lambda side, row: F.expr(f"{side}._file = _f and {side}._sheet = _s and {side}._row = {row}")
    pairs = met.join(rows.alias("x"), of("x", "a")).join(rows.alias("y"), of("y", "b"))
    used = [(F.trim(f"x.v{i}") != "") | (F.trim(f"y.v{i}") != "") for i in range(len(columns))]
    n = sum((u.cast("int") for u in used), F.lit(0))
    size = lambda i: (F.length(f"x.v{i}"), F.length(f"y.v{i}"))
    most = [F.when(u, 2.0 * F.least(*size(i)) / F.greatest(size(i)[0] + size(i)[1], F.lit(1))).otherwise(0.0) for i, u in enumerate(used)]
    common = lambda i: F.size(F.array_intersect(_letters(F.col(f"x.v{i}")), _letters(F.col(f"y.v{i}"))))
    shared = [F.when(u, 2.0 * common(i) / F.greatest(size(i)[0] + size(i)[1], F.lit(1))).otherwise(0.0) for i, u in enumerate(used)]
    possible = pairs.where((n >= LEAST_COLUMNS) & (sum(most, F.lit(0.0)) >= threshold * n - 1e-9)).where(sum(shared, F.lit(0.0)) >= threshold * n - 1e-9).withColumn("_n", n)
    scores = [F.when(u, indel_ratio(F.col(f"x.v{i}"), F.col(f"y.v{i}"))).otherwise(0.0) for i, u in enumerate(used)]
    edges = possible.withColumn("score", sum(scores, F.lit(0.0)) / F.col("_n")).where(F.col("score") >= threshold - 1e-12)
    return edges.selectExpr("x._file as _file", "x._sheet as _sheet", "x._row as a", "y._row as b", "score")


def _reported(edges: DataFrame) -> DataFrame:
    """(_file, _sheet, _row, like_row, score): the rows that are like an earlier kept one, from saved edges."""
    sheet, reported, left = ["_file", "_sheet"], edges.select("_file", "_sheet", F.col("b").alias("row")).limit(0), edges
    while not left.isEmpty():
        later = left.select(*sheet, F.col("b").alias("a")).distinct()
        leaders = left.select(*sheet, "a").distinct().join(later, [*sheet, "a"], "left_anti")
        found = saved(left.join(leaders, [*sheet, "a"], "left_semi").select(*sheet, F.col("b").alias("row")).distinct())
        reported = reported.unionByName(found)
        # decided rows take no further part, neither as earlier nor as later ones
        decided = found.unionByName(leaders.withColumnRenamed("a", "row"))
        left = saved(left.join(decided.withColumnRenamed("row", "a"), [*sheet, "a"], "left_anti").join(found.withColumnRenamed("row", "b"), [*sheet, "b"], "left_anti"))
    kept = edges.join(reported.withColumnRenamed("row", "a"), [*sheet, "a"], "left_anti").join(reported.withColumnRenamed("row", "b"), [*sheet, "b"], "left_semi")
    return kept.groupBy(*sheet, F.col("b").alias("_row")).agg(F.min(F.struct("a", "score")).alias("first")).select(*sheet, "_row", F.col("first.a").alias("like_row"), F.col("first.score").alias("score"))


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", indel_ratio(F.col("value"), F.col("code")))


def compared_codes(values: DataFrame, book: DataFrame, n: int) -> DataFrame:
    """(value, code, ord, score): pairs among which are the n best codes of each value, and few others.

    values: (value), distinct.  book: (code, ord), distinct.  First each value is
    compared with some codes that share one of its two letters that are rarest among
    codes, and with the first n codes: its n-th best score there is a threshold.  Then it meets the
    codes that share one of its letters, rarest first, as long as what is left could reach
    the threshold, and is compared with those whose length and letters could.
    """
    small = book.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES
    held = lambda df: F.broadcast(df) if small else df
    codes = saved(book.withColumn("code_letters", _letters(F.col("code"))))
    tokens = codes.select("code", "ord", "code_letters", F.explode("code_letters").alias("letter"))
    often = tokens.groupBy("letter").agg(F.count(F.lit(1)).alias("often"))
    letters = values.withColumn("letters", _letters(F.col("value")))
    each = letters.select("value", "letters", F.explode("letters").alias("letter")).join(held(often), "letter")
    by = Window.partitionBy("value").orderBy("often", "letter")
    left = F.count(F.lit(1)).over(Window.partitionBy("value")) - F.row_number().over(by) + 1
    each = saved(each.select("value", "letters", "letter", F.row_number().over(by).alias("place"), left.alias("left")))
    meet = lambda some: some.join(held(tokens), "letter")
    # no more than n codes: a value that shares letters with fewer than n takes them
    first = [(r["code"], r["ord"]) for r in book.orderBy("ord", "code").limit(n).collect()]
    fill = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(o).cast(book.schema["ord"].dataType).alias("ord")) for c, o in first)) if first else None
    filled = values.select("value", F.inline(fill)) if first else values.join(codes.select("code", "ord").limit(0))
    most = lambda shared, other: 2.0 * shared / (F.length("value") + other)
    likely = meet(each.where("place <= 2")).select("value", "code", "ord", most(F.size(F.array_intersect("letters", "code_letters")), F.length("code")).alias("most")).distinct()
    # any comparisons give a threshold; those of the codes with the most letters in common give a good one
    tried = likely.withColumn("_r", F.row_number().over(Window.partitionBy("value").orderBy(F.desc("most"), "ord", "code"))).where(F.col("_r") <= 2 * n)
    start = saved(_scored(tried.select("value", "code", "ord").unionByName(filled).distinct()))
    best = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("score"), "ord", "code"))
    least = start.withColumn("_r", best).where(F.col("_r") == n).select("value", F.col("score").alias("least"))
    bounded = each.join(least, "value", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - 1e-9)
    open_ = bounded.where(most(F.col("left"), F.col("left")) >= F.col("least"))
    met = meet(open_).where(most(F.least(F.length("value"), F.length("code")), F.length("code")) >= F.col("least")).select("value", "letters", "least", "code", "ord", "code_letters").dropDuplicates(["value", "code"])
    near = met.where(most(F.size(F.array_intersect("letters", "code_letters")), F.length("code")) >= F.col("least"))
    known = start.select("value", "code")
    return start.unionByName(_scored(near.select("value", "code", "ord").join(known, ["value", "code"], "left_anti")))


def nearest_codes(df: DataFrame, c: str, codes: DataFrame, n: int = 3) -> DataFrame:
    """(value, rank, code, score): for each value of a column that is no code of codes (code, ord), the n most similar codes.

    Distinct values are compared with the codes that can be among the n best, see
    compared_codes(); of equal scores the code with the smaller ord comes first.  The
    codes are broadcast up to BROADCAST_CODES; beyond it joins go by letter with a shuffle.
    """
    book = codes.select(F.trim("code").alias("code"), "ord").where("code != ''").groupBy("code").agg(F.min("ord").alias("ord"))
    values = df.select(F.trim(F.col(f"`{c}`")).alias("value")).where(~N.is_blank(F.col("value"))).distinct().join(book, F.col("value") == F.col("code"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("score"), "ord", "code"))
    return compared_codes(values, book, n).withColumn("rank", rank).where(F.col("rank") <= n).select("value", "rank", "code", "score")


def near_duplicate_issues(df: DataFrame, columns: list[str], threshold: float = 0.85, block: list[str] | None = None) -> DataFrame:
    """near_duplicate_rows as issues of the first of the columns, to be approved; value says how alike."""
    found = near_duplicate_rows(df, columns, threshold, block)
    value = F.concat(F.lit("유사도 "), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%"))
    return found.select(*KEYS, F.lit(columns[0]).alias("column"), F.lit("NEAR_DUPLICATE").alias("rule_id"), F.lit("approval").alias("tier"), value.alias("value"), "like_row")
