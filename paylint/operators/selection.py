"""Exact percentiles by selection: counts tell in which part of the values a rank lies, and only that part is looked at further."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylint.sources.tables import saved

#: Different values of a group that are put in order in one task, about.
HELD = 200_000
#: A group's values are cut into so many parts of about equal size in each round.
PARTS = 64
#: Tables of at most this many rows, a few for each group, are broadcast.
FEW = 10_000


def few(table: DataFrame, rows: int = FEW) -> DataFrame:
    """A saved table of groups, marked for broadcast if it has at most `rows` rows; with more of them a shuffle spreads the groups."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def percentiles(df: DataFrame, by: list[str], value: Column, qs: list[float], held: int = HELD) -> DataFrame:
    """(by, n, q0, q1, ...): the percentiles of each group's values as doubles, exact, with linear interpolation; nulls are no values.

    A rank is looked for between two bounds, at first anywhere.  While there are more
    different values between them than `held`, a sketch of bounded size proposes parts,
    the values in each are counted, and the part with the rank gives the next
    bounds.  What remains is counted by value, so repeated values combine, and put
    in order.  No task holds a group's values; a round leaves about one PARTS-th of them.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = saved(df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)), value.cast("double").alias("x")).where("x is not null"))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("x").alias("different"))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(q).alias("q")) for i, q in enumerate(qs)))).alias("t")
    place = n.select(*keys, "n", "different", at).select(*keys, "n", "different", "t.i", (F.col("t.q") * (F.col("n") - 1)).alias("position"))
    none = F.lit(None).cast("double")
    bounds = saved(place.select("*", F.floor("position").alias("low"), F.ceil("position").alias("high"), none.alias("from"), none.alias("to"), F.lit(0).cast("long").alias("below")))
    while True:
        wide = bounds.where(F.col("different") > held)
        if wide.isEmpty():
            break
        found = saved(_narrowed(rows, saved(wide), keys))
        bounds = saved(bounds.where(F.col("different") <= held).unionByName(found))
    inside = _within(rows, few(bounds), keys).groupBy(*keys, "i", "x").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("x"))
    ranked = inside.withColumn("upto", upto).alias("r").join(bounds.alias("b"), _same("r", "b", [*keys, "i"]))
    last = F.col("b.below") + F.col("r.upto") - 1
    first = last - F.col("r.c") + 1
    holds = lambda rank: F.max(F.when(F.col(f"b.{rank}").between(first, last), F.col("r.x")))
    ends = ranked.groupBy(*(F.col(f"b.{k}").alias(k) for k in keys), "b.i", "b.n", "b.position", "b.low", "b.high").agg(holds("low").alias("x0"), holds("high").alias("x1"))
    q = F.when(F.col("low") == F.col("high"), F.col("x0")).otherwise((F.col("high") - F.col("position")) * F.col("x0") + (F.col("position") - F.col("low")) * F.col("x1"))
    out = ends.groupBy(*keys, "n").agg(*(F.max(F.when(F.col("i") == i, q)).alias(f"q{i}") for i in range(len(qs))))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "n", *(f"q{i}" for i in range(len(qs))))


def _same(a: str, b: str, keys: list[str]) -> Column:
    return F.expr(" and ".join([f"{a}.{k} <=> {b}.{k}" for k in keys] or ["true"]))


def _within(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, x, ...): the values between the bounds of each rank; a group has a row of bounds for each percentile."""
    b = bounds.select(*(F.col(k).alias(f"b{k}") for k in keys), "i", "from", "to", F.struct("low", "high", "below", "different").alias("state"))
    on = F.expr(" and ".join([f"{k} <=> b{k}" for k in keys] or ["true"]) + " and (from is null or x >= from) and (to is null or x <= to)")
    return rows.join(b, on).select(*keys, "i", "x", "from", "to", "state")


def _narrowed(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """bounds around the same ranks with fewer values between them."""
    key = [*keys, "i"]
    inside = _within(rows, few(bounds), keys)
    cuts = inside.groupBy(*key).agg(F.array_distinct(F.percentile_approx("x", [k / PARTS for k in range(1, PARTS)], F.lit(20 * PARTS))).alias("cuts"))
    cut = inside.alias("v").join(few(saved(cuts)).alias("c"), _same("v", "c", key)).select("v.*", "c.cuts")
    # a value equal to a cut is a part of its own: one that is very frequent stands alone
    part = F.size(F.filter("cuts", lambda c: c < F.col("x"))) * 2 + F.array_contains("cuts", F.col("x")).cast("int")
    parts = cut.groupBy(*key, "state", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("from"), F.max("x").alias("to"), F.approx_count_distinct("x").alias("different"))
    last = F.col("state.below") + F.sum("c").over(Window.partitionBy(*key).orderBy("part")) - 1
    placed = parts.withColumn("last", last).withColumn("first", F.col("last") - F.col("c") + 1)
    # the parts that hold the lower and the upper rank; they are next to each other, or one
    needed = placed.where((F.col("state.low").between(F.col("first"), F.col("last"))) | (F.col("state.high").between(F.col("first"), F.col("last"))))
    merged = needed.groupBy(*key).agg(F.min("from").alias("from"), F.max("to").alias("to"), F.min("first").alias("below"), F.sum("different").alias("different"))
    old = bounds.select(*key, "n", "position", "low", "high", F.col("different").alias("_were"))
    joined = merged.alias("m").join(old.alias("o"), _same("m", "o", key))
    # two parts of one value each are enough; what doesn't shrink is one value and its neighbour
    left = F.when(F.col("m.different") < F.col("o._were"), F.col("m.different")).otherwise(F.lit(0).cast("long"))
    return joined.select(*(F.col(f"o.{k}").alias(k) for k in keys), "o.n", left.alias("different"), "o.i", "o.position", "o.low", "o.high", "m.from", "m.to", "m.below")
