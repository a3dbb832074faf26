"""Overlaps against brute force over all windows."""

import re

import numpy as np

from paylint.llm import decontamination

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    """(doc_id, item_id, doc_at, n_words, n_equal): of the windows that differ in few words the one with the most equal, the earliest of these."""
    out = set()
    for doc, text in docs:
        d = words(text)
        for item, benchmark in items:
            t = words(benchmark)
            n = min(13, len(t))
            if len(t) < 8:
                continue
            found = [(sum(d[i + k] == t[j + k] for k in range(n)), -i) for i in range(len(d) - n + 1) for j in range(len(t) - n + 1)]
            equal, at = max(found, default=(0, 0))
            if equal >= n - (2 if n == 13 else 1):
                out.add((doc, item, -at, n, equal))
    return out


def planted(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(4, 30)))) for i in range(25)]
    docs = []
    for i in range(60):
        d = list(rng.choice(vocabulary, rng.integers(0, 80)))
        if i % 2:
            t = words(items[rng.integers(0, len(items))][1])
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(0, len(t))] = "Other"
            d[10:10] = t
        docs.append((i, " ".join(d)))
    long = " ".join(["lorem"] * 30_000 + words(items[0][1]) * 2)
    return [*docs, (100, None), (101, ""), (102, long), (103, items[1][1].upper()), (103, items[1][1].upper())], [*items, (90, None), (91, ""), (92, " ".join(["lorem"] * 13))]


def test_same_as_brute_force(spark):
    docs, items = planted(3)
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    wanted = plain([d for d in docs if d[0] != 102], items)
    rows = sorted((r["doc_id"], r["item_id"], r["doc_at"], r["n_words"], r["n_equal"]) for r in got if r["doc_id"] != 102)
    assert rows == sorted(wanted) and len(wanted) > 10
    assert {r["item_id"] for r in got if r["doc_id"] == 102} >= {0, 92}
    left = decontamination.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in left) == sorted(d for d, _ in docs if d not in {r[0] for r in rows} | {102})
