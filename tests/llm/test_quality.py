"""The hierarchy against a plain version, held-out accuracy, and odd rows."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paylint.llm import quality

#: (doc, host, path, log odds): a rich site, a bad path of it, a sparse site, sites without a name.
ROWS = [
    *((i, "rich", "a", 2.0 + i % 3 / 10) for i in range(40)), *((100 + i, "rich", "b", -2.0) for i in range(30)), *((200 + i, "poor", "a", 0.1 * (i % 5) - 2.2) for i in range(50)),
    (300, "sparse", "a", -0.2), (301, None, "a", 0.3), (302, None, None, -0.1), (303, "rich", None, 0.05), (304, "rich", "b", 0.4), (304, "rich", "b", 0.4), (None, "poor", "a", 0.2), (305, "rich", "a", 0.0), (306, "poor", "a", 0.0),
]
LABELS = {3: 0, 105: 1, 201: 0, 300: 1, 304: 0, 999: 1}


def plain(rows, labels):
    """As the docstrings have it, in floating point; the operator rounds what it sums to six digits."""
    own = [labels.get(d, 1 / (1 + math.exp(-e))) for d, _, _, e in rows]
    own = [round(p * 1e6) / 1e6 for p in own]
    n = len(rows)
    prior = (sum(own) + 0.5) / (n + 1)

    def strength(groups, means):
        k, size = len(groups), sum(map(len, groups.values()))
        within = max(sum(sum(p * p for p in g) - sum(g) ** 2 / len(g) for g in groups.values()) / (size - k), 1e-9)
        free = size - sum(len(g) ** 2 for g in groups.values()) / size
        between = (sum(len(g) * (sum(g) / len(g) - means[s]) ** 2 for s, g in groups.items()) - (k - 1) * within) / free
        return min(1e6, max(1.0, within / between)) if between > 0 else 1e6

    hosts, paths = defaultdict(list), defaultdict(list)
    for (_, h, p, _), x in zip(rows, own, strict=True):
        hosts[h].append(x)
        paths[h, p].append(x)
    k = strength(hosts, defaultdict(lambda: prior))
    host_mean = {h: (sum(g) + k * prior) / (len(g) + k) for h, g in hosts.items()}
    k = strength(paths, {s: host_mean[s[0]] for s in paths})
    out = []
    for (d, h, p, e), _ in zip(rows, own, strict=True):
        x, g = labels.get(d, 1 / (1 + math.exp(-e))), paths[h, p]
        others = min(max((max(sum(g) - x, 0) + k * host_mean[h]) / (len(g) - 1 + k), 1e-4), 1 - 1e-4)
        odds = e + math.log(others / (1 - others)) - math.log(prior / (1 - prior))
        out.append((d, odds, host_mean[h], (sum(g) + k * host_mean[h]) / (len(g) + k), 1 / (1 + math.exp(-odds)) >= 0.5))
    return out


def order(r):
    return (r[0] is None, r[0] or 0, r[1])


@pytest.fixture(scope="module")
def results(spark):
    rows = spark.createDataFrame([((d,), d, h, p, e) for d, h, p, e in ROWS], "row struct<doc_id long>, doc long, host string, path string, e double")
    good = spark.createDataFrame(list(LABELS.items()), "doc_id long, good int")
    return [tuple(r) for r in quality.combined(rows, good).select("doc", "log_odds", "host_posterior", "path_posterior", "keep").collect()]


def test_same_as_plain(results):
    got, wanted = sorted(results, key=order), sorted(plain(ROWS, LABELS), key=order)
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted, strict=True):
        assert g[0] == w[0] and g[4] == w[4] and g[1:4] == pytest.approx(w[1:4], abs=1e-5), (g, w)


def test_sites_decide_where_texts_do_not(results):
    """Equal texts are kept on a rich good site and rejected on a bad one; a sparse site is drawn toward the global mean more than a rich one."""
    of = {r[0]: r for r in results}
    assert of[305][4] and not of[306][4]
    mean = lambda h, p: [sum(x) / len(x) for x in [[LABELS.get(d, 1 / (1 + math.exp(-e))) for d, a, b, e in ROWS if (a, b) == (h, p)]]][0]
    assert mean("sparse", "a") - of[300][3] > 0.1 > abs(mean("rich", "a") - of[305][3])


def test_held_out(spark):
    """Labelled documents that were not used: good ones stay, bad ones go."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rest = quality.judged(docs, labels.where("doc_id % 5 > 0"), text=False).join(quality.goods(labels.where("doc_id % 5 = 0")), "doc_id")
    n = {(r["good"], r["keep"]): r["count"] for r in rest.groupBy("good", "keep").count().collect()}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0))


def test_odd_rows(spark):
    """Names of the operator's own columns, repeated and null identifiers, null and very long texts, labels that don't count."""
    rows = [(1, "some words", "a"), (1, "some words", "b"), (None, None, "c"), (2, "x " * 400_000, "d"), (3, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, e string").withColumns({c: F.lit("clash") for c in ("host", "path", "row", "doc", "good", "_h", "_s_n", "keep", "n", "s", "source", "lang")})
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (2, 0, 0), (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels)
    assert sorted(got.columns) == sorted([*docs.columns, "log_odds", "host_posterior", "path_posterior", "probability"])
    out = got.collect()
    assert sorted(r["e"] for r in out) == ["a", "b", "c", "d", "e"] and {r["row"] for r in out} == {"clash"}
