import random

from paylint.operators import graph


def _rounds(monkeypatch):
    """Counts the tables written: two before the first round, two in each."""
    seen = []
    real = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: seen.append(1) or real(df))
    return lambda: (len(seen) - 2) // 2


def test_long_chain_in_few_rounds(spark, monkeypatch):
    rounds = _rounds(monkeypatch)
    names = [f"{i:04d}" for i in range(600)]
    random.Random(3).shuffle(names)
    links = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    assert [(r["label"], r["count"]) for r in graph.components(links).groupBy("label").count().collect()] == [("0000", 600)]
    assert rounds() <= 12


def test_components_against_search(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(170)] + [("n1", "n1")]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    wanted = {}
    for n in sorted(near):
        todo = [n] if n not in wanted else []
        while todo:
            if (x := todo.pop()) not in wanted:
                wanted[x] = n
                todo += near[x]
    got = graph.components(spark.createDataFrame(pairs, "a string, b string"))
    assert {r["node"]: r["label"] for r in got.collect()} == wanted and len(set(wanted.values())) > 20
    assert graph.components(spark.createDataFrame([("x", "x")], "a string, b string")).collect() == []
