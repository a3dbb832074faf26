"""The five stages on a small corpus with planted copies, benchmark passages, nulls and repeats, against a plain version."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from paylint.llm import quality, queries
import test_decontamination

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def made():
    rng = np.random.default_rng(8)
    vocabulary = [f"word{i}" for i in range(400)]
    docs, labels, items = [], [], [(i, " ".join(rng.choice(vocabulary, 20))) for i in range(6)] + [(9, None), (10, "short")]
    for i in range(150):
        words = list(rng.choice(vocabulary, rng.integers(40, 120)))
        if i % 7 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 11 == 3:
            words[20:20] = items[i % 6][1].split()
        docs.append((i, " ".join(words), ["en", "de", None][i % 3], f"s{i % 4}" if i % 9 else None))
        if i % 2:
            labels.append((i, int(i % 7 != 0), 0))
    for k in range(30):
        i, text, lang, source = docs[int(rng.integers(0, 150))]
        words = text.split()
        if k % 3:
            words[int(rng.integers(0, len(words)))] = f"changed{k}"
        docs.append((None if k % 10 == 0 else 200 + k if k % 4 else i, " ".join(words), lang, source))
    docs += [docs[5], docs[5], (500, None, "en", "s0"), (501, "", None, None), (None, None, None, None), (502, "one two", "en", "s1"), (503, "lorem " * 20_000, "en", "s2")]
    return [(*d, len(d[1] or "")) for d in docs], labels, items


def shingles(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def one_of_each_group(rows):
    sets, label = [shingles(r[1]) for r in rows], list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    groups = defaultdict(list)
    for r, k in zip(rows, label):
        groups[k].append(r)
    # which text of a shared smallest identifier stays is a matter of hashes
    return [(min(g, key=lambda r: (r[0] is None, r[0] or 0))[0], {r[1] for r in g}) for g in groups.values()]


def poisson(doc_id, text, rate):
    key = str(doc_id) if doc_id is not None else "null:" + hashlib.md5((text or "").encode()).hexdigest()
    parts, n = max(1, math.ceil(rate / 16)), 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"mix:{key}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = cdf = math.exp(-rate / parts)
        for k in range(1, 129):
            if cdf > u:
                break
            p = p * (rate / parts) / k
            cdf, n = cdf + p, n + 1
    return n if rate > 0 else 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage."""
    path, (docs, labels, items) = str(tmp_path_factory.mktemp("corpus")), made()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows, df = [docs], spark.read.parquet(f"{path}/documents.parquet")
    flags = quality.judged(df, spark.read.parquet(f"{path}/labels.parquet")).where("keep").select(COLUMNS).collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = corpus_pipeline.saved(stage(spark, df, path), name)
        assert i == 4 or df.columns == COLUMNS, name
        rows.append([tuple(r) for r in df.collect()])
    return rows, sorted(map(str, map(tuple, flags))), items


def test_quality(stages):
    rows, flags, _ = stages
    assert sorted(map(str, rows[1])) == flags and 0.5 * len(rows[0]) < len(rows[1]) < len(rows[0])


def test_near_duplicates(stages):
    before, after = stages[0][1], stages[0][2]
    wanted = one_of_each_group(before)
    assert sorted(str(r[0]) for r in after) == sorted(str(d) for d, _ in wanted) and len(after) < len(before)
    left = [*wanted]
    for r in after:
        left.remove(next(w for w in left if w[0] == r[0] and r[1] in w[1]))


def test_decontamination_stage(stages):
    before, after, items = stages[0][2], stages[0][3], stages[2]
    # a long text of one word, which no item has, is left out of the comparison of all windows
    bad = {(d, t) for d, t in {r[:2] for r in before} if len(t or "") < 50_000 and test_decontamination.plain([(d, t)], items)}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r[:2] not in bad) and bad


def test_mixing(stages):
    before, after = stages[0][3], stages[0][4]
    sizes = defaultdict(float)
    for r in before:
        sizes[r[3]] += len(r[1] or "")
    weights = {s: math.sqrt(x) for s, x in sizes.items()}
    rate = {s: weights[s] * sum(sizes.values()) / sum(weights.values()) / sizes[s] if sizes[s] else 0.0 for s in sizes}
    assert sorted(map(str, after)) == sorted(str(r) for r in before for _ in range(poisson(r[0], r[1], rate[r[3]])))


def test_token_ids(stages):
    from tokenizers import Tokenizer

    before, after = stages[0][4], stages[0][5]
    t = Tokenizer.from_file(queries.tokenizer_path())
    ids = [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in before]
    assert sorted((str(r[0]), r[2], r[3]) for r in after) == sorted((str(d), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    start = 0
    for r in sorted(after, key=lambda r: r[1]):
        assert r[1] == start
        start += r[2]
    known = [r[0] for r in sorted(after, key=lambda r: r[1]) if r[0] is not None]
    assert known == sorted(known)


def test_whole_run(spark):
    sf_dir = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
