"""Tool-call linking against a plain version, on made-up graphs and on the turns of the given table."""

import json
import random

from paylint.llm import chat, queries

CALLS = "conv_id long, call_id string, turn long, parents array<string>, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"


def least(rows):
    """The first of rows, nulls before all else."""
    return min(rows, key=lambda r: [(x is not None, [(y is not None, y or "") for y in x] if isinstance(x, list) else x if x is not None else 0) for x in r])


def plain_order(calls):
    """{call_id: (start turn, start id, level)} of one conversation, calls {call_id: (turn, parents)}."""
    place = {i: (t, i) for i, (t, _) in calls.items()}
    edges = [(place[i], place[p]) for i, (_, ps) in calls.items() for p in set(ps or []) if p in place]
    stretches = []
    for c, p in sorted(e for e in edges if e[1] >= e[0]):
        if stretches and c <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], p)
        else:
            stretches.append([c, p])
    out = {i: (*place[i], 0) for i in calls}
    for lo, hi in stretches:
        inside = {i for i in calls if lo <= place[i] <= hi}
        level, open_ = 0, {(c[1], p[1]) for c, p in edges if c[1] in inside and p[1] in inside}
        while inside:
            ready = inside - {c for c, _ in open_} or None
            for i in ready or inside:
                out[i] = (*lo, level if ready else None)
            if not ready:
                break
            inside -= ready
            open_ = {e for e in open_ if e[1] not in ready}
            level += 1
    return out


def plain_error(text, schema):
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return "not JSON"
    if text is None:
        return "not JSON"
    if not isinstance(value, dict):
        return "not an object"
    kinds = {"string": str, "integer": int, "object": dict, "array": list}

    def first(value, schema, shown):
        for p in schema:
            name, x = shown + p["name"], value.get(p["name"])
            if x is None:
                if p.get("required"):
                    return f"{name}: missing"
                continue
            if not isinstance(x, kinds[p["type"]]):
                return f"{name}: not {p['type']}"
            if "items" in p and not all(isinstance(y, kinds[p["items"]]) for y in x):
                return f"{name}: not all {p['items']}"
            if "enum" in p and x not in p["enum"]:
                return f"{name}: not in enum"
            if "minimum" in p and x < p["minimum"]:
                return f"{name}: below minimum"
            if "maximum" in p and x > p["maximum"]:
                return f"{name}: above maximum"
            if "properties" in p and (found := first(x, p["properties"], f"{name}.")):
                return found
        return None

    return first(value, schema, "")


def plain_link(calls, results, schemas):
    out, by, answers = [], {}, {}
    for conv, i, turn, parents, name, arguments in calls:
        if conv is None or i is None:
            out.append((conv, i, turn, turn if turn is not None else -1, i, 0, 1, 0, (name, arguments), None))
        else:
            by.setdefault((conv, i), []).append((turn, name, arguments, parents))
    for conv, i, turn, content in results:
        if conv is not None and i is not None:
            answers.setdefault((conv, i), []).append((turn, content))
    firsts = {k: least(v) for k, v in by.items()}
    places = {}
    for conv in {c for c, _ in firsts}:
        of = {i: (r[0] if r[0] is not None else -1, r[3]) for (c, i), r in firsts.items() if c == conv}
        places |= {(conv, i): x for i, x in plain_order(of).items()}
    for k in firsts.keys() | answers.keys():
        turn, name, arguments, _ = firsts.get(k, (None,) * 4)
        start = places.get(k, (None, None, None))
        out.append((*k, turn, *start, len(by.get(k, [])), len(answers.get(k, [])), (name, arguments), least(answers[k])[1] if k in answers else None))
    rows = []
    for conv, i, turn, start, first, level, n_calls, n_results, (name, arguments), content in out:
        error = plain_error(arguments, schemas[name]) if n_calls and name in schemas else None
        status = "no_call" if not n_calls else "cycle" if level is None else "unknown_tool" if name not in schemas else "bad_arguments" if error else "no_result" if not n_results else "ok"
        message = {"id": i, "name": name, "result": content, "role": "tool"}
        try:
            message["arguments"] = json.loads(arguments) if arguments is not None else None
        except ValueError:
            message["arguments"] = arguments
        text = json.dumps({k: v for k, v in message.items() if v is not None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        rows.append((conv, i, turn, start, first, level, n_calls, n_results, status, error, text))
    return rows


def compared(calls, results, linked, schemas):
    got = linked.select("conv_id", "call_id", "turn", "start_turn", "start_id", "level", "n_calls", "n_results", "status", "argument_error", "message").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_link(calls, results, schemas)))
    return {r["status"] for r in got}


def test_given_turns(spark):
    """All conversations of a given table; every status occurs."""
    calls, results = queries.tool_turns(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    linked = chat.link(calls, results, queries.TOOLS)
    seen = compared([tuple(r) for r in calls.collect()], [tuple(r) for r in results.collect()], linked, queries.TOOLS)
    assert seen == {"ok", "no_call", "cycle", "unknown_tool", "bad_arguments", "no_result"}


def test_random_graphs(spark):
    rng = random.Random(7)
    calls, results = [], []
    for conv in range(12):
        n = rng.choice([3, 8, 30])
        for k in range(n):
            parents = [f"c{rng.randrange(max(1, k)) if rng.random() < 0.85 else rng.randrange(n + 2)}" for _ in range(rng.randrange(4))]
            calls.append((conv, f"c{k}", rng.choice([k, k, k, k // 2, None, k * 1000]), rng.choice([parents, parents, None]), rng.choice(["s", "t", None]), rng.choice(['{"q":"é \\" x","a":{"z":1,"b":[1,2]}}', '{"q":5}', "bad", "[]", None, "{}"])))
            results += [(conv, f"c{k}", rng.randrange(9), rng.choice(["x", "y", None]))] * rng.randrange(3)
    calls += [(None, "f", 1, ["c1"], "s", '{"q":"y"}'), (3, None, None, [], "s", "{}"), (1, "c0", 0, None, "s", "{}")]
    results += [(None, "f", 1, "lost"), (2, None, 1, "lost"), (2, "zz", None, "z" * 300_000)]
    schemas = {"s": [{"name": "q", "type": "string", "required": True}]}
    linked = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas)
    assert "cycle" in compared(calls, results, linked, schemas)
    # calls that are not on a cycle come after their parents
    rows = {(r["conv_id"], r["call_id"]): (r["start_turn"], r["start_id"], r["level"], r["turn"] if r["turn"] is not None else -1, r["call_id"]) for r in linked.collect() if r["conv_id"] is not None and r["call_id"] is not None and r["n_calls"] and r["level"] is not None}
    parents = {(r["conv_id"], r["call_id"]): r["parents"] or [] for r in linked.collect()}
    assert rows and all(rows[c, p] < at for (c, i), at in rows.items() for p in parents[c, i] if (c, p) in rows)


def test_empty_and_repeated(spark):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 0, "x")], RESULTS)
    assert chat.link(calls, spark.createDataFrame([], RESULTS), {}).count() == 0
    assert [(r["status"], r["n_results"]) for r in chat.link(calls, results, {}).collect()] == [("no_call", 2)]
