"""Group rules over payments: how many, how much, and how close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylint.functions import normalize as N
from paylint.operators.drafts import key_text
from paylint.operators.graph import components
from paylint.sources.tables import saved

COMPANY, PROGRAM, DATE, AMOUNT = "사업자번호", "사업명", "지원일자", "지원금액"


def prepared(df: DataFrame, programs: list[str] | None = None) -> DataFrame:
    """Payments with canonical company keys, year, day and amount; unreadable values are null."""
    if programs:
        df = df.where(F.col(PROGRAM).isin(programs))
    if COMPANY in df.columns:
        df = df.withColumn(COMPANY, N.business_key(F.col(COMPANY)))
    return df.withColumns({"year": N.year(F.col(DATE)), "day": N.date(F.col(DATE))["value"], "amount": N.amount(F.col(AMOUNT))})


def _keys(group_by: list[str], period: str) -> list[str]:
    return [*group_by, *(["year"] if period == "year" else [])]


def max_count(df: DataFrame, group_by: list[str], most: int = 1, distinct: str | None = None, period: str = "year", programs: list[str] | None = None) -> DataFrame:
    """Groups with more rows (or distinct values of a column) than `most`. Blank and null keys are groups too."""
    n = F.count(F.lit(1)) if distinct is None else F.count_distinct(F.col(distinct))
    return prepared(df, programs).groupBy(*_keys(group_by, period)).agg(n.alias("n"), F.count(F.lit(1)).alias("n_rows"), F.min("_row").alias("first_row")).where(F.col("n") > most)


def sum_limit(df: DataFrame, group_by: list[str], most: int, scope: str = "total", period: str = "year", programs: list[str] | None = None) -> DataFrame:
    """Groups whose readable amounts add up to more than `most`; the scope per_business adds the program to the key."""
    keys = _keys(group_by if scope == "total" or PROGRAM in group_by else [*group_by, PROGRAM], period)
    sums = prepared(df, programs).groupBy(*keys).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n_rows"))
    return sums.where(F.col("total") > most).withColumn("excess", F.col("total") - most)


def members(df: DataFrame, found: DataFrame, group_by: list[str], period: str = "year", programs: list[str] | None = None) -> DataFrame:
    """The payments in the groups that max_count or sum_limit found; group_by has all their keys but the year. Null keys fit null ones."""
    keys = _keys(group_by, period)
    groups = found.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return prepared(df, programs).join(groups, on, "left_semi")


def group_cells(df: DataFrame, found: DataFrame, group_by: list[str], rule_id: str, metric: Column, period: str = "year", programs: list[str] | None = None) -> DataFrame:
    """(group_id, rule_id, metric, key, _file, _sheet, _row): the payments of the groups that max_count or sum_limit found; key names the group, with the number masked."""
    keys = _keys(group_by, period)
    groups = found.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), metric.alias("metric"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    named = F.concat_ws("|", F.lit(rule_id), *(F.coalesce(F.col(k), F.lit("")) for k in keys))
    shown = {k: F.col(k) for k in keys}
    return prepared(df, programs).join(groups, on).select(F.substring(F.sha2(named, 256), 1, 16).alias("group_id"), F.lit(rule_id).alias("rule_id"), "metric", key_text(shown).alias("key"), "_file", "_sheet", "_row")


def payment_limit(df: DataFrame, most: int, programs: list[str] | None = None) -> DataFrame:
    return prepared(df, programs).where(F.col("amount") > most)


def near_payments(df: DataFrame, group_by: list[str], days: int = 30, programs: list[str] | None = None) -> DataFrame:
    """Chains of payments of the same amount in a group, each at most `days` after the one before: one row for each chain of two or more.

    Payments of a group, amount, day and file are counted first; chains are then found
    by sorting the different days of a group and amount, at most those of a calendar
    however many payments there are, without comparing pairs.  Payments whose day or
    amount is unreadable are not looked at.
    """
    rows = prepared(df, programs).where("day is not null and amount is not null")
    counted = rows.groupBy(*group_by, "amount", "day", "_file").agg(F.count(F.lit(1)).alias("n"))
    days_of = counted.select(*group_by, "amount", "day").distinct()
    by = Window.partitionBy(*group_by, "amount").orderBy("day")
    begins = F.when(F.coalesce(F.datediff("day", F.lag("day").over(by)) > days, F.lit(True)), F.col("day"))
    chained = days_of.withColumn("_begins", begins).withColumn("chain", F.last("_begins", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")
    keys = [*group_by, "amount", "day"]
    named = chained.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), "chain")
    joined = counted.join(named, F.expr(" and ".join(f"`{k}` <=> _k{i}" for i, k in enumerate(keys))))
    return joined.groupBy(*group_by, "amount", "chain").agg(F.sum("n").alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("_file").alias("n_files")).where("n_rows > 1").drop("chain")


def reconcile(detail: DataFrame, summary: DataFrame, key: str, count: str, total: str) -> DataFrame:
    """Keys whose number of payments or sum differs between detail and summary, or that one of them lacks."""
    d = detail.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(N.amount(F.col(AMOUNT))).alias("sum"))
    s = summary.select(F.col(key).alias("_key"), N.amount(F.col(count)).alias("n_summary"), N.amount(F.col(total)).alias("sum_summary"))
    both = d.join(s, F.col(key).eqNullSafe(F.col("_key")), "full")
    return both.where(~F.col("n").eqNullSafe(F.col("n_summary")) | ~F.col("sum").eqNullSafe(F.col("sum_summary"))).select(F.coalesce(key, "_key").alias(key), "n", "n_summary", "sum", "sum_summary")


def excluded(df: DataFrame) -> Column:
    return F.count_if(F.length(N.digits(F.col(COMPANY))) != 10)


#: Columns of a table of group rules: see evaluated().
SPEC = "spec_id string, template string, group_by array<string>, distinct string, most long, scope string, period string, programs array<string>"


def specs_from_master(master: DataFrame) -> DataFrame:
    """Up to three rules, columns SPEC, for each row of a master table of programs that names one.

    A: more rows than the yearly number for a program and company.  B: more than one
    row for an agency and company, if repeats are not allowed.  C: a sum over the
    limit of a company.  All look at the row's program alone, year by year.  Rules
    are numbered by the master's row (_row, from 2 on, as the readers give it), so codes may
    be missing or repeated.  Numbers that are not digits alone give no rule.
    """
    name, number = F.trim("사업명"), lambda c: F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("long"))
    row = F.lpad((F.col("_row") - 1).cast("string"), F.greatest(F.lit(4), F.length((F.col("_row") - 1).cast("string"))), F.lit("0"))

    def rule(part: str, template: str, by: list[str], most: Column, scope: str | None = None) -> Column:
        values = (F.concat(F.lit("RS-"), row, F.lit(part)), F.lit(template), F.array(*map(F.lit, by)), F.lit(None).cast("string"), most, F.lit(scope).cast("string"), F.lit("year"), F.array(name))
        return F.struct(*(v.alias(c.split()[0]) for v, c in zip(values, SPEC.split(", "), strict=True)))

    yearly = F.when(number("연간허용횟수") >= 1, number("연간허용횟수"))
    once = F.when(F.upper(F.trim("시군내중복허용")) == "N", F.lit(1).cast("long"))
    rules = F.array(rule("A", "MAX_COUNT", [PROGRAM, COMPANY], yearly), rule("B", "MAX_COUNT", ["기관명", COMPANY], once), rule("C", "SUM_LIMIT", [COMPANY], number("기업당한도"), "per_business"))
    return master.where(name != "").select(F.inline(rules)).where("most is not null")


def _expanded(df: DataFrame, specs: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """Payments with each rule that looks at them, and the rule's key for the payment: an array of values in the order of its columns.

    A rule without programs looks at all.  Each payment has two tokens, its program
    and one for all, and a rule one for each of its programs, so both meet in a join of equals.
    """
    every = F.lit(None).cast("string")
    scoped = F.when((F.col("scope") == "per_business") & ~F.array_contains("group_by", PROGRAM), F.concat("group_by", F.array(F.lit(PROGRAM)))).otherwise(F.col("group_by"))
    told = specs.withColumn("group_by", scoped).withColumn("_token", F.explode(F.when(F.size("programs") > 0, F.transform(F.array_distinct("programs"), lambda p: F.struct(F.lit(True).alias("one"), p.alias("name")))).otherwise(F.array(F.struct(F.lit(False).alias("one"), every.alias("name"))))))
    told = F.broadcast(told) if told.limit(rows + 1).count() <= rows else told
    values = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))))
    tokens = F.array(F.struct(F.lit(True).alias("one"), F.col(PROGRAM).alias("name")), F.struct(F.lit(False).alias("one"), every.alias("name")))
    paid = prepared(df).select("_file", "_sheet", "_row", "year", "amount", values.alias("_values"), F.explode(tokens).alias("_t"))
    joined = paid.join(told, (F.col("_t.one") == F.col("_token.one")) & F.col("_t.name").eqNullSafe(F.col("_token.name")))
    key = F.transform("group_by", lambda c: F.element_at("_values", c))
    return joined.select("spec_id", "template", "group_by", "distinct", "most", key.alias("key"), F.when(F.col("period") == "year", F.col("year")).alias("year"), "amount", F.when(F.col("distinct").isNotNull(), F.element_at("_values", F.col("distinct"))).alias("_value"), "_file", "_sheet", "_row")


def evaluated(df: DataFrame, specs: DataFrame, columns: list[str] = ("기관명", PROGRAM, "수혜기업명", COMPANY), rows: int = 100_000) -> DataFrame:
    """(spec_id, group_by, key, year, n, n_rows, total): the groups that break a rule of specs, all rules in one aggregation.

    specs, columns SPEC: template is MAX_COUNT (rows, or different values of the
    column `distinct`, above `most`) or SUM_LIMIT (readable amounts above `most`);
    group_by names columns of any set out of `columns`, to which the scope
    per_business adds the program; period year makes each year a group of its own, else
    year is null; programs are those it looks at, null for all.  key has the values
    of group_by, null and blank ones too; n is what was counted.  Values are
    counted once a group before groups are summed, so hot groups don't gather.
    The specs are broadcast up to `rows` rows.
    """
    found = _expanded(df, specs, list(columns), rows)
    keys = ["spec_id", "template", "group_by", "distinct", "most", "key", "year"]
    each = found.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amount").alias("total"))
    sums = each.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total"), F.count("_value").alias("_n"))
    sums = sums.withColumn("n", F.when(F.col("distinct").isNull(), F.col("n_rows")).otherwise(F.col("_n")))
    breaks = F.when(F.col("template") == "MAX_COUNT", F.col("n") > F.col("most")).when(F.col("template") == "SUM_LIMIT", F.col("total") > F.col("most")).otherwise(False)
    return sums.where(breaks).select("spec_id", "group_by", "key", "year", "n", "n_rows", "total")


def spec_rows(df: DataFrame, specs: DataFrame, found: DataFrame, columns: list[str] = ("기관명", PROGRAM, "수혜기업명", COMPANY), rows: int = 100_000) -> DataFrame:
    """(spec_id, key, year, _file, _sheet, _row): the payments of the groups that evaluated() found."""
    groups = found.select(F.col("spec_id").alias("_spec"), F.col("key").alias("_key"), F.col("year").alias("_year"))
    on = (F.col("spec_id") == F.col("_spec")) & F.col("key").eqNullSafe(F.col("_key")) & F.col("year").eqNullSafe(F.col("_year"))
    return _expanded(df, specs, list(columns), rows).join(groups, on, "left_semi").select("spec_id", "key", "year", "_file", "_sheet", "_row")


def under_scopes(df: DataFrame, group_by: list[str], limits: dict[str, int], period: str = "year") -> DataFrame:
    """sum_limit under several scopes at once: (scope, keys ..., total), null for keys that a scope lacks."""
    keys = _keys([*group_by, *([] if PROGRAM in group_by else [PROGRAM])], period)
    out = None
    for scope, most in limits.items():
        found = payment_limit(df, most).select(*keys, F.col("amount").alias("total")) if scope == "per_payment" else sum_limit(df, group_by, most, scope, period)
        part = found.select(F.lit(scope).alias("scope"), *(F.col(k) if k in found.columns else F.lit(None).cast("string").alias(k) for k in keys), "total")
        out = part if out is None else out.union(part)
    return out


def near_payments_open(df: DataFrame, group_by: list[str], days: int = 30, programs: list[str] | None = None, tol_pct: float = 0.0) -> DataFrame:
    """As near_payments, but an unreadable day or amount fits every other: (group, n_rows, first_day, last_day, several_files) of each component of two rows or more.

    Payments of equal group, day and amount count as one cell.  Cells of one amount
    are chained by day.  Wildcards are linked to few chains that stand for all they
    fit: an amount-less cell to the chains of the cells next to it in time, a
    day-less one to all chains of its amount, and day-less and amount-less ones to
    the first of the other kind in their group.  No pairs are compared.

    tol_pct: amounts fit that differ by so many percent of the larger at most (below
    100); zero fits zero alone.  A cell then has a band of amounts that all fit, and
    chains of bands next to each other are linked by _beside().
    """
    _, _, units, g, _ = _near_cells(df, group_by, days, programs, tol_pct)
    sums = units.groupBy("label", *g).agg(F.sum("n").alias("n_rows"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), (F.min("lo") != F.max("hi")).alias("several_files"))
    return sums.where("n_rows > 1").select(*(F.col(a).alias(k) for k, a in zip(group_by, g, strict=True)), "n_rows", "first_day", "last_day", "several_files")


def near_payment_rows(df: DataFrame, group_by: list[str], columns: list[str], days: int = 30, programs: list[str] | None = None, tol_pct: float = 0.0) -> DataFrame:
    """(group_id, kind, n_rows, _file, _sheet, _row) of the payments in the groups of near_payments_open().

    kind: several_files, same_rows if every row has another with equal values in all
    of the columns, else double.
    """
    rows, cells, units, _, keys = _near_cells(df, group_by, days, programs, tol_pct)
    cell = cells.withColumn("unit", _named(keys)).join(units.select("unit", "label"), "unit").select("label", *(F.col(c).alias(f"_p{c}") for c in [*keys, "day"]))
    labelled = rows.join(cell, [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in [*keys, "day"]]).select("label", "_file", "_sheet", "_row")
    whole = df.select("_file", "_sheet", "_row", F.xxhash64(*(F.col(f"`{c}`") for c in columns)).alias("_same"))
    labelled = saved(labelled.join(whole, ["_file", "_sheet", "_row"]))
    equal = labelled.groupBy("label", "_same").agg(F.count(F.lit(1)).alias("n"), F.min("_file").alias("lo"), F.max("_file").alias("hi"))
    groups = equal.groupBy("label").agg(F.sum("n").alias("n_rows"), F.min("n").alias("least"), (F.min("lo") != F.max("hi")).alias("several")).where("n_rows > 1")
    kind = F.when(F.col("several"), "several_files").when(F.col("least") > 1, "same_rows").otherwise("double")
    return labelled.join(groups.withColumn("kind", kind), "label").select(F.substring(F.sha2("label", 256), 1, 16).alias("group_id"), "kind", "n_rows", "_file", "_sheet", "_row")


def _band(amount: Column, tol_pct: float) -> Column:
    """Bands of amounts a hair narrower than the tolerance, so that rounding cannot put unlike amounts into one; like ones are two bands apart at most."""
    return F.when(amount == 0, F.lit(0).cast("long")).otherwise(F.floor(_place(amount, tol_pct)))


def _place(amount: Column, tol_pct: float) -> Column:
    return F.log(F.abs(amount).cast("double")) / -F.log(F.lit(1 - tol_pct / 100)) * 1.000001


def _fits(p: str, q: str, tol_pct: float) -> str:
    return f"abs({p} - {q}) * 100 <= {tol_pct} * greatest(abs({p}), abs({q}))"


def _named(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys, "chain"), {"ignoreNullFields": "false"})


def _beside(cells: DataFrame, g: list[str], days: int, tol_pct: float) -> DataFrame:
    """Links (a, b) of the units of dated cells (_g..., _sign, _band, chain, day, least, most) whose amounts lie in different bands.

    A cell's largest amount fits a band above if it fits the smallest amount there of the
    days at most `days` before or after.  Those before are of one chain, and those after, as
    their steps are no longer than that, so two looks a band find every link.  Two bands
    above only amounts at the lower edge of theirs can fit.
    """
    keys = [*g, "_sign", "_band"]
    edge = _place(F.col("least"), tol_pct) - F.col("_band") < 0.001
    moves = F.when(edge, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    placed = cells.select(*keys, "chain", "least", "most", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("_day"), F.explode(moves).alias("_m")).withColumn("_at", F.col("_band") - F.col("_m"))
    by = Window.partitionBy(*g, "_sign", "_at").orderBy("_day")
    of = lambda c, m, w: F.min(F.when(F.col("_m") == m, F.col(c))).over(w)
    looks = [F.struct(F.lit(m).alias("m"), of("least", m, w).alias("least"), of("chain", m, w).alias("chain")) for w in (by.rangeBetween(-days, 0), by.rangeBetween(0, days)) for m in (1, 2)]
    met = placed.withColumn("_met", F.array(*looks)).where("_m = 0").select(*keys, "chain", "most", F.explode("_met").alias("y")).where(_fits("most", "y.least", tol_pct))
    # few are left of a chain's links before they are named
    links = met.select(*keys, "chain", "y.m", F.col("y.chain").alias("other")).distinct().withColumn("a", _named(keys))
    return links.withColumns({"_band": F.col("_band") + F.col("m"), "chain": F.col("other")}).select("a", _named(keys).alias("b"))


def _near_cells(df: DataFrame, group_by: list[str], days: int, programs: list[str] | None, tol_pct: float) -> tuple[DataFrame, DataFrame, DataFrame, list[str], list[str]]:
    """Payments, their cells with a chain, the units with counts and the label of the component, the columns of a group, and those of a cell but the day.

    A unit is a chain of cells of a group and amount, or band, with steps of at most
    `days`, or their cell without a day, whose chain is -1.
    """
    g = [f"_g{i}" for i in range(len(group_by))]
    keys = [*g, *(("_sign", "_band") if tol_pct else ("amount",))]

    def read(df: DataFrame, *more: str) -> DataFrame:
        out = prepared(df, programs).select(*(F.col(k).alias(a) for k, a in zip(group_by, g, strict=True)), "amount", "day", *more)
        return out.withColumns({"_sign": F.signum("amount").cast("int"), "_band": _band(F.col("amount"), tol_pct)}) if tol_pct else out

    rows = read(df, "_file", "_sheet", "_row")
    # equal texts are counted first and read once, by as many tasks as the shuffle has
    texts = dict.fromkeys([*(k for k in group_by if k not in ("year", "day", "amount")), DATE, AMOUNT, *([PROGRAM] if programs else [])])
    counted = df.groupBy(*texts).agg(F.count(F.lit(1)).alias("_n"), F.min("_file").alias("_lo"), F.max("_file").alias("_hi"))
    cells = read(counted, "_n", "_lo", "_hi").groupBy(*keys, "day").agg(F.sum("_n").alias("n"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.min(F.abs("amount")).alias("least"), F.max(F.abs("amount")).alias("most"))
    # a window has no more rows than the calendar
    by = Window.partitionBy(*keys).orderBy("day")
    fresh = F.when(F.col("day").isNotNull(), F.coalesce(F.datediff("day", F.lag("day").over(by)) > days, F.lit(True)).cast("int"))
    chain = F.when(F.col("day").isNull(), F.lit(-1)).otherwise(F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    cells = saved(cells.withColumn("_new", fresh).withColumn("chain", chain.cast("long")).drop("_new"))
    units = cells.groupBy(*keys, "chain").agg(F.sum("n").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least").alias("least"), F.max("most").alias("most"))
    units = saved(units.withColumn("unit", _named(keys)))
    same = lambda other, columns: F.expr(" and ".join(f"u.{k} <=> {other}.{k}" for k in columns))

    # a payment without day and amount fits all of its group, where no other links are needed
    fits_all = units.where("least is null and first_day is null").select(*g, F.col("unit").alias("b")).alias("f")
    links = [units.alias("u").join(fits_all, same("f", g)).selectExpr("u.unit as a", "f.b")]
    dated = cells.where("day is not null").alias("u").join(fits_all, same("f", g), "left_anti")
    u = units.alias("u").join(fits_all, same("f", g), "left_anti").alias("u")

    # the days of a group, with the chain of that day's payments without amount
    by_day = dated.groupBy(*g, "day").agg(F.min(F.when(F.col("least").isNull(), F.col("chain"))).alias("open"))
    before, after = (Window.partitionBy(*g).orderBy(order).rowsBetween(Window.unboundedPreceding, 0) for order in (F.asc("day"), F.desc("day")))
    open_ = F.when(F.col("open").isNotNull(), F.struct("day", "open"))
    beside = by_day.select(*(F.col(c).alias(f"n{c}") for c in g), F.col("day").alias("nday"), F.array(*(F.last(open_, ignorenulls=True).over(w) for w in (before, after))).alias("sides"))
    beside = beside.select("*", F.explode("sides").alias("side")).where(F.abs(F.datediff("nday", "side.day")) <= days)
    met = F.expr(" and ".join([*(f"{c} <=> n{c}" for c in g), "day = nday"]))
    met = dated.where("least is not null").join(beside, met).select(*keys, "chain", F.col("side.open").alias("other")).distinct().withColumn("a", _named(keys))
    unread = {k: F.lit(None).cast(cells.schema[k].dataType) for k in keys if k not in g}
    links.append(met.withColumns({**unread, "chain": F.col("other")}).select("a", _named(keys).alias("b")))

    dayless, fit = u.where("first_day is null and least is not null").select(*keys, "unit", "least", "most"), "true"
    if tol_pct:
        links.append(_beside(dated.where("least is not null"), g, days, tol_pct))
        # amounts without a day meet units in the bands next to theirs by the smallest and largest amounts, of which two fit if any do
        dayless = dayless.withColumn("_band", F.explode(F.sequence(F.col("_band") - 2, F.col("_band") + 2)))
        fit = " or ".join(f"({_fits(f'u.{p}', f'd.{q}', tol_pct)})" for p in ("least", "most") for q in ("least", "most"))
    links.append(u.join(dayless.alias("d"), same("d", keys) & F.expr(fit)).selectExpr("u.unit as a", "d.unit as b"))
    firsts = u.groupBy(*g).agg(*(F.min(F.when(F.col(c).isNull(), F.col("unit"))).alias(f) for c, f in (("least", "f_amount"), ("first_day", "f_day"))))
    firsts = u.join(firsts.where("f_amount is not null and f_day is not null").alias("f"), same("f", g))
    links.append(firsts.selectExpr("u.unit as a", "case when u.least is null then f.f_day when u.first_day is null then f.f_amount end as b").where("b is not null"))
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    found = components(every)
    return rows, cells, units.join(found.withColumnRenamed("node", "unit"), "unit", "left").withColumn("label", F.coalesce("label", "unit")), g, keys
