import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paylint.llm import boosted_rules, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a b c a b c a b", "x " * 60, "one\ntwo\none\n\n \n one\none", "#*$%&|<> é日本 ü\x85w", "line a\r\nline a\r\nline a", "w" * 200 + " " + "w" * 200, " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), "a a a a", "\x0bword\x0cword\x1cword"]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


COLUMNS = [*boosted_rules.STATISTICS, "base_failed"]


def test_statistics_equal_a_plain_version(spark, monkeypatch):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = [*ODD, *given, "long line of words " * 20_000]
    want = [plain(t) for t in texts]
    for piece in (50, 2 << 20):
        monkeypatch.setattr(boosted_rules, "PIECE", piece)
        counts = boosted_rules.statistics(pa.array(texts))
        assert [(*c, bool(f)) for c, f in zip(counts.tolist(), boosted_rules.failed(counts), strict=True)] == want
    df = spark.createDataFrame([(i, t, "kept", 7) for i, t in enumerate(texts)], "doc_id long, text string, _measured string, n_words int").repartition(3)
    got = boosted_rules.text_statistics(df)
    assert got.columns == ["doc_id", "text", "_measured", *COLUMNS]
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()} == dict(enumerate(want))


def walk(trees, x):
    out = trees.base
    for node in trees.roots:
        while trees.left[node] != node:
            node = trees.left[node] if x[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        out += trees.value[node]
    return out


def test_trees_learn_keep_their_signs_and_score_as_a_walk_does():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    x[:, 3] = np.round(x[:, 3])
    # feature 0 helps but where 1 is high, which its sign forbids; 2 harms
    y = (np.where(x[:, 1] > 1, -x[:, 0], x[:, 0]) - x[:, 2] + 0.3 * rng.normal(size=3000) > 0).astype(float)
    signs = np.array([1, 0, -1, 0])
    trees = boosted_rules.grow(x, y, signs, trees=40)
    score = trees.score(x)
    assert ((score > 0) == (y > 0)).mean() > 0.85
    assert np.allclose(score[:200], [walk(trees, r) for r in x[:200]])
    free = boosted_rules.grow(x, y, np.zeros(4, int), trees=40)
    broken = 0
    for f, sign in ((0, 1), (2, -1)):
        for step in (0.01, 0.3, 2.0, 9.0):
            moved = x.copy()
            moved[:, f] += step
            assert (sign * (trees.score(moved) - score) >= -1e-12).all()
            broken += (sign * (free.score(moved) - free.score(x)) < -1e-6).sum()
    assert broken > 0
    assert len(trees.value) == len(trees.left) == len(trees.threshold) and trees.score(x[:0]).shape == (0,)


def test_without_both_labels_the_limits_decide(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, ODD[10])], "doc_id long, text string")
    labels = spark.createDataFrame([(10, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = boosted_rules.judged(docs, some).collect()
        assert len(got) == len(ODD) + 1 and all(r["kept"] == (not r["base_failed"]) for r in got)
    assert boosted_rules.judged(docs.limit(0), labels).count() == 0


def test_unseen_labels(spark):
    """Good documents that the limits pass stay, toxic and bad ones go; a clashing column is replaced."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", F.lit("x").alias("kept"))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = boosted_rules.judged(docs, labels.where("doc_id % 5 > 0")).where("not base_failed")
    rest = judged.join(quality.goods(labels.where("doc_id % 5 = 0")), "doc_id").groupBy("good").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.count(F.lit(1)).alias("n"))
    got = {r["good"]: (r["kept"], r["n"]) for r in rest.collect()}
    print(got)
    assert got[1][0] >= 0.99 and got[0][0] <= 0.2
