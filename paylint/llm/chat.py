"""Chat formatting: link tool calls with their results, order them, check arguments, write canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

#: JSON types of a parameter and the variant types that satisfy them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL\\(.*\\)|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>"}


def argument_errors(arguments: Column, schema: list[dict]) -> Column:
    """The first violation of a tool's schema, or null.

    arguments is a VARIANT (null: not JSON).  schema: dicts with name, type (see
    TYPES), and optionally required, enum, minimum, maximum, items (the type of an
    array's elements) and properties (a schema of an object's fields).
    """
    checks = [F.when(arguments.isNull(), F.lit("not JSON")), F.when(~F.schema_of_variant(arguments).startswith("OBJECT<"), F.lit("not an object"))]
    return F.coalesce(*checks, *_violations(arguments, schema, "$", ""))


def _violations(arguments: Column, schema: list[dict], inside: str, shown: str) -> list[Column]:
    checks = []
    for p in schema:
        name, at = shown + p["name"], f"{inside}['{p['name']}']"
        value = F.try_variant_get(arguments, at, "variant")
        there = value.isNotNull() & ~F.is_variant_null(value)
        if p.get("required"):
            checks.append(F.when(~there, F.lit(f"{name}: missing")))
        checks.append(F.when(there & ~F.schema_of_variant(value).rlike(f"(?s)^{TYPES[p['type']]}$"), F.lit(f"{name}: not {p['type']}")))
        if "items" in p:
            checks.append(F.when(there & ~F.schema_of_variant(value).rlike(f"(?s)^ARRAY<({TYPES[p['items']]}|VOID)>$"), F.lit(f"{name}: not all {p['items']}")))
        if "enum" in p:
            checks.append(F.when(there & ~F.try_variant_get(arguments, at, "string").isin([str(x) for x in p["enum"]]), F.lit(f"{name}: not in enum")))
        number = F.try_variant_get(arguments, at, "double")
        if "minimum" in p:
            checks.append(F.when(there & (number < p["minimum"]), F.lit(f"{name}: below minimum")))
        if "maximum" in p:
            checks.append(F.when(there & (number > p["maximum"]), F.lit(f"{name}: above maximum")))
        if "properties" in p:
            checks += [F.when(there, c) for c in _violations(arguments, p["properties"], at, f"{name}.")]
    return checks


def order(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, start_turn, start_id, level): sorted by these and turn, every call comes after those whose results it uses.

    calls: (conv_id, call_id, turn, parents), one row for each identifier; turn is
    not null.  A call at (turn, call_id) whose parents are all at smaller places is
    in order where it is.  A parent at a greater or equal place makes the places from
    the call's to the parent's a stretch; stretches that overlap are one.  Only calls
    of stretches are ordered anew: their level is the longest path of parents inside
    the stretch, found by taking away calls without open parents in rounds, as many
    as the stretch is deep.  Calls that are left, on a cycle or behind one in their
    stretch, have no level.  A stretch's calls start at its first place, all others
    at their own with level 0.

    Calls meet stretches in an equi-join on (conversation, size, place of that size),
    so a long conversation doesn't gather in one task; only the stretches of a
    conversation are sorted by one.
    """
    place = lambda a: F.struct(F.col(f"{a}.turn").alias("turn"), F.col(f"{a}.call_id").alias("call_id"))
    asked = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("parents")).alias("parent"))
    edges = asked.alias("c").join(calls.select("conv_id", "call_id", "turn").alias("p"), F.expr("c.conv_id = p.conv_id and c.parent = p.call_id"))
    edges = saved(edges.select("c.conv_id", place("c").alias("child"), place("p").alias("parent")), "edges")
    by = Window.partitionBy("conv_id").orderBy("child", "parent")
    late = edges.where("parent >= child").withColumn("_far", F.max("parent").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    late = late.withColumn("_n", F.count_if(F.coalesce(F.col("_far") < F.col("child"), F.lit(True))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.expr("cast(ceil(log2(hi.turn - lo.turn + 1)) as int)")
    stretches = saved(late.groupBy("conv_id", "_n").agg(F.min("child").alias("lo"), F.max("parent").alias("hi")).select("conv_id", "lo", "hi", size.alias("size")), "stretches")
    sizes = [r[0] for r in stretches.select("size").distinct().collect()]
    alone = calls.select("conv_id", "call_id", F.col("turn").alias("start_turn"), F.col("call_id").alias("start_id"), F.lit(0).cast("long").alias("level"))
    if not sizes:
        return alone
    at = lambda turn: F.expr(f"cast(floor({turn} / shiftleft(1L, size)) as bigint)")
    dealt = stretches.select(F.col("conv_id").alias("_c"), "lo", "hi", F.col("size").alias("_size"), F.explode(F.array_distinct(F.array(at("lo.turn"), at("hi.turn")))).alias("_at"))
    tried = calls.select("conv_id", F.struct("turn", "call_id").alias("place"), F.explode(F.array(*map(F.lit, sizes))).alias("size")).withColumn("at", at("place.turn"))
    inside = tried.join(dealt, F.expr("conv_id = _c and size = _size and at = _at and place between lo and hi"))
    inside = saved(inside.select("conv_id", "place", "lo").distinct(), "inside")

    child, parent = (inside.withColumnsRenamed({"place": e, "lo": f"{e}_lo"}) for e in ("child", "parent"))
    open_ = saved(edges.join(child, ["conv_id", "child"]).join(parent, ["conv_id", "parent"]).where("child_lo = parent_lo").select("conv_id", "child", "parent").distinct(), "open")
    done, left, level = None, inside, 0
    while not left.isEmpty():
        waiting = open_.select("conv_id", F.col("child").alias("place")).distinct()
        ready = saved(left.join(waiting, ["conv_id", "place"], "left_anti").withColumn("level", F.lit(level).cast("long")), "ready")
        if ready.isEmpty():
            ready = left.withColumn("level", F.lit(None).cast("long"))
            done = ready if done is None else done.unionByName(ready)
            break
        done = ready if done is None else done.unionByName(ready)
        left = saved(left.join(waiting, ["conv_id", "place"], "left_semi"), "left")
        open_ = saved(open_.join(ready.select("conv_id", F.col("place").alias("parent")), ["conv_id", "parent"], "left_anti"), "open")
        level += 1
    moved = done.select(F.col("conv_id").alias("_c"), F.col("place.call_id").alias("_i"), "lo", F.col("level").alias("_level"))
    both = alone.join(moved, F.expr("conv_id = _c and call_id = _i"), "left")
    there = F.col("_i").isNotNull()
    return both.select("conv_id", "call_id", F.when(there, F.col("lo.turn")).otherwise(F.col("start_turn")).alias("start_turn"), F.when(there, F.col("lo.call_id")).otherwise(F.col("start_id")).alias("start_id"), F.when(there, F.col("_level")).otherwise(F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, list[dict]]) -> DataFrame:
    """One row for each identifier of a conversation: the call, its result, its place in the order and its canonical JSON.

    calls: (conv_id, call_id, turn, parents, name, arguments); parents is an array
    of the calls whose results this one uses, null or empty if none.  results:
    (conv_id, call_id, turn, content).  Both may hold other columns, which are not
    used.  Arguments and contents of any length are taken whole.

    The rows that share an identifier are reduced before the join, with map-side
    combining, to the first by turn (then by content), and counted.  status is the
    first that holds of: no_call (a result without a call), cycle, unknown_tool,
    bad_arguments, no_result, ok.  Calls come before those that use their results
    when sorted by (conv_id, start_turn, start_id, level, turn, call_id), see
    order(); a parent that doesn't exist counts as none, a call without turn comes
    first, as if its turn were -1.  A row without conv_id or call_id links with
    nothing: such calls are kept with level 0, such results dropped.  message has
    sorted keys and no spaces, at every depth; arguments that are not JSON go in as
    text.  Empty tables give what the other has.
    """
    first = F.min(F.struct(F.col("turn"), F.col("name"), F.col("arguments"), F.col("parents")))
    linked = calls.where("conv_id is not null and call_id is not null")
    c = linked.groupBy("conv_id", "call_id").agg(first.alias("_first"), F.count(F.lit(1)).alias("n_calls")).select("conv_id", "call_id", "_first.*", "n_calls")
    r = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("_r"), F.count(F.lit(1)).alias("n_results")).select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("_r.turn").alias("result_turn"), F.col("_r.content").alias("content"), "n_results")
    c = saved(c, "calls")
    places = order(c.select("conv_id", "call_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "parents")).withColumnsRenamed({"conv_id": "_lc", "call_id": "_li"})
    both = c.join(r.hint("shuffle_hash"), (F.col("conv_id") == F.col("_conv")) & (F.col("call_id") == F.col("_call")), "full")
    both = both.select(F.coalesce("conv_id", "_conv").alias("conv_id"), F.coalesce("call_id", "_call").alias("call_id"), "turn", "name", "arguments", "parents", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), "result_turn", "content", F.coalesce("n_results", F.lit(0)).alias("n_results"))
    both = both.join(places, (F.col("conv_id") == F.col("_lc")) & (F.col("call_id") == F.col("_li")), "left").drop("_lc", "_li")
    loose = calls.where("conv_id is null or call_id is null")
    both = both.unionByName(loose.select("conv_id", "call_id", "turn", "name", "arguments", "parents", F.lit(1).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("level"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("start_turn"), F.col("call_id").alias("start_id")), allowMissingColumns=True).fillna(0, ["n_results"])
    parsed = both.withColumn("_args", F.try_parse_json("arguments"))
    error = F.lit(None).cast("string")
    for tool, schema in schemas.items():
        error = F.when(F.col("name") == tool, argument_errors(F.col("_args"), schema)).otherwise(error)
    called = F.col("n_calls") > 0
    known = F.coalesce(F.col("name").isin(list(schemas)), F.lit(False))
    status = (
        F.when(~called, "no_call").when(F.col("level").isNull(), "cycle").when(~known, "unknown_tool").when(F.col("argument_error").isNotNull(), "bad_arguments").when(F.col("n_results") == 0, "no_result").otherwise("ok")
    )
    judged = parsed.withColumn("argument_error", F.when(called & known, error)).withColumn("status", status)
    return judged.withColumn("message", _message()).drop("_args", "arguments", "content").select(
        "conv_id", "call_id", "turn", "name", "parents", "start_turn", "start_id", "level", "n_calls", "result_turn", "n_results", "status", "argument_error", "message"
    )


def _message() -> Column:
    """{"arguments":...,"id":...,"name":...,"result":...,"role":"tool"}, keys in order; absent parts are left out."""

    def part(key: str, json: Column) -> Column:
        return F.when(json.isNotNull(), F.concat(F.lit(f'"{key}":'), json))

    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    quoted = lambda c: F.when(F.col(c).isNotNull(), text(c))
    arguments = F.when(F.col("_args").isNotNull(), F.to_json("_args")).otherwise(quoted("arguments"))
    return F.concat(F.lit("{"), F.concat_ws(",", part("arguments", arguments), part("id", quoted("call_id")), part("name", quoted("name")), part("result", quoted("content")), F.lit('"role":"tool"')), F.lit("}"))
