"""Small tables with nulls, empty and long texts, ties, repeats and odd columns, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylint.llm import arrays, bitslices, decontamination, jaccard, mixing, pii, quality, queries, substrings, tokens, url_filter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BASE = [f"word{i % 37}x{i}" for i in range(120)]


def texts():
    near = [*BASE]
    near[7] = "other"
    far = [w + "z" if i % 9 == 0 else w for i, w in enumerate(BASE)]
    return [
        (5, " ".join(BASE)), (3, " ".join(BASE).upper()), (9, "\n".join(near)), (11, " ".join(far)), (2, None), (4, ""), (6, " \t\n"), (8, "one two"), (10, "One  two"),
        (12, " ".join(BASE[:60] + ["q"] * 30)), (13, " ".join(["lorem ipsum dolor"] * 400)), (14, " ".join(BASE[40:] + ["tail"])), (15, "x" * 3000 + " é 日本"), (16, " ".join(BASE)), (16, " ".join(BASE)),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", 1) for i, t in texts()], "doc_id long, text string, lang string, source string, n_chars long")


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    given = ["", "a", " b  c\x0b", None, "é\x85ü x", "z" * 200 + " y", "Ab aB"]
    data, offsets = arrays.utf8(pa.array(given))
    w = arrays.split(data, offsets)
    got = [data[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)]
    assert got == [x for t in given for x in WORDS.findall(t or "")]
    assert len(set(w.hashes().tolist())) == len(set(got))


def test_jaccard(docs):
    def shingles(t):
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    rows = [(i, shingles(t)) for i, t in texts()]
    least = [i for i, _ in rows]
    for _ in rows:
        for a, (_, x) in enumerate(rows):
            for b, (_, y) in enumerate(rows):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    least[a] = least[b] = min(least[a], least[b])
    wanted = sorted((i, len(s), c) for (i, s), c in zip(rows, least, strict=True))
    assert sorted(map(tuple, jaccard.classes(docs).collect())) == wanted


def test_jaccard_of_families(spark):
    rng = np.random.default_rng(1)
    rows = []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(80)]
        for _ in range(30):
            w = list(base)
            for p in rng.integers(0, 80, rng.integers(0, 5)):
                w[p] = f"r{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for _, t in rows]
    least = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for a in range(len(rows)):
            for b in range(a):
                if least[a] != least[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
                    moved = True
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == least


def test_one_row_of_each_group_stays(spark):
    """Copies without identifier, repeated rows, and texts that share their identifier with a copy."""
    a, b, c = " ".join(BASE), " ".join(BASE[:-1] + ["end"]), " ".join(f"own{i}" for i in range(50))
    rows = [(1, a, 0), (2, b, 1), (2, c, 2), (3, c, 3), (None, a, 4), (None, a, 5), (None, "alone in this table here now", 6), (None, "alone in this table here now", 7), (4, "", 8), (4, "", 9), (None, None, 10), (5, "one two", 11), (5, "one two", 12), (1, a, 13)]
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:7]) for r in jaccard.distinct(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect())
    assert got == sorted([(1, a[:7]), (2, c[:7]), (0, "alone i"), (4, ""), (4, ""), (0, ""), (5, "one two")])


def test_substrings(docs):
    check_substrings(docs, texts())


def test_substrings_of_hot_minimisers(spark, monkeypatch):
    """All minimisers dealt by window: lines that a text repeats, in one document and in many."""
    monkeypatch.setattr(substrings, "HOT", 0)
    line = [f"l{i}" for i in range(9)]
    rows = [(i, " ".join([f"d{i}", *(line * (40 if i == 3 else 3)), *BASE[: 20 + i], "end", *(line * 2)])) for i in range(12)]
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def check_substrings(docs, given):
    rows = [(i, WORDS.findall(t or "")) for i, t in given]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            s = tuple(w[k : k + 13])
            first[s] = min(i, first.get(s, i))
    wanted = []
    for i, w in rows:
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        wanted.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(tuple, substrings.digests(substrings.removed(docs)).collect())) == sorted(wanted)


def test_windows_of_one_fingerprint():
    """Fingerprints that different windows share change nothing: the words decide."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = [" ".join(rng.choice(["a", "bb", "é", "dd"], 40)) + ("\t" if i % 2 else " ") + "one two three four five" for i in range(30)]
    data, offsets = arrays.utf8(pa.array(rows))
    w = arrays.split(data, offsets)
    at = np.flatnonzero(w.windows(5))
    doc = np.repeat(np.arange(30) // 2, w.n)[at]
    words = [WORDS.findall(t) for t in rows]
    said = [tuple(words[r][k : k + 5]) for r in range(30) for k in range(len(words[r]) - 4)]
    least = {}
    for s, d in zip(said, doc.tolist()):
        least[s] = min(d, least.get(s, d))
    wanted = [d > least[s] for s, d in zip(said, doc.tolist())]
    a, b = substrings._fingerprints(w.hashes(), 5)
    for mask in (2**64 - 1, 7, 1, 0):
        got = substrings._groups(a[at] & np.uint64(mask), b[at] & np.uint64(mask), doc, w, at, 5)
        assert got.tolist() == wanted and any(wanted) and not all(wanted)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_tokens(spark, docs, encoding):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    start, wanted = 0, []
    for i, text in sorted(texts(), key=lambda r: r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens.encoded(docs, queries.tokenizer_path(), encoding=encoding).collect())) == wanted


def test_token_range(spark, docs, tmp_path):
    tokens.write(docs, f"file://{tmp_path}/t", queries.tokenizer_path())
    some = tokens.tokens(spark, f"file://{tmp_path}/t", 8, 12)
    assert sorted(r["doc_id"] for r in some.collect()) == [8, 9, 10, 11, 12]
    whole = {(r["doc_id"], r["start"]) for r in tokens.metadata(spark, f"file://{tmp_path}/t").collect()}
    assert {(r["doc_id"], r["start"]) for r in some.collect()} <= whole


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (150, 5)) / 10
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (250, [None] * 5), (300, [float("nan")] * 5), (350, [0.1, -0.2, 0.3, 0.0, 0.2])]
    q = np.floor(256 * np.array([x for _, x in rows[:150]] + [rows[-1][1]])).astype(int)
    ids = np.array([*range(150), 350])
    wanted = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = q @ q[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        wanted += [(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    got = bitslices.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_top_k_of_equal_vectors(spark):
    """5,000 equal vectors tie: the smallest identifiers are found, and a task passes on k rows a query."""
    rows = spark.range(5000).select((4999 - F.col("id")).alias("vec_id"), F.array(F.lit(0.5), F.lit(-0.25)).alias("embedding"))
    got = bitslices.top_k(rows, F.col("vec_id") % 500 == 0)
    wanted = [(q, r + 1, v, 128 * 128 + 64 * 64) for q in range(0, 5000, 500) for r, v in enumerate([i for i in range(6) if i != q][:5])]
    assert sorted(map(tuple, got.collect())) == wanted


def test_index_is_searched_again(spark):
    vectors = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * (i + 1)) for i in range(7))).alias("embedding"))
    indexed, bits = bitslices.index(vectors)
    asked = vectors.where("vec_id = 7").withColumn("vec_id", F.lit(-1).cast("long"))
    assert bitslices.search(indexed, bits, asked, 1).first()["vec_id"] == bitslices.search(indexed, bits, asked, 300).first()["vec_id"]
    assert bitslices.search(indexed, bits, asked, 400).count() == 300


def test_decontamination(spark):
    item = [f"b{i}" for i in range(20)]
    swapped = [*item]
    swapped[6] = swapped[15] = "swapped"
    broken = [w if i % 4 else "no" for i, w in enumerate(item)]
    pad = [f"p{i}" for i in range(30)]
    rows = [(1, " ".join(pad + item + pad)), (2, " ".join(pad + swapped)), (3, " ".join(broken + pad)), (4, None), (5, " ".join(item[:12])), (6, " ".join(item).upper()), (7, "short item of eight words is now here")]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "short item of eight words is right here"), (4, "tiny")], "item_id long, text string")
    got = decontamination.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_equal"]) for r in got) == [(1, 1, 13), (2, 1, 12), (6, 1, 13), (7, 3, 7)]
    left = decontamination.clean(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5]


def test_pii(spark):
    rows = [(1, "é mail a.b+c@ex-1.org.uk, or x@y"), (2, "ip 10.0.0.255 and 1.2.3.256 and 1.2.3.4.5.6.7.8"), (3, "card 4111 1111-1111 1111, not 4111 1111 1111 1112"), (4, "call +1 (800) 555-0100 now"), (5, None), (6, ""), (7, "9" * 50000), (8, "plain words only")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), pii.Field()).collect()}
    assert got[1]["base"] == "email:7:24" and got[1]["n_email"] == 1
    assert got[2]["base"] == "ip:3:13,ip:32:39,ip:40:47"
    assert got[3]["base"] == "card:5:24" and got[4]["base"] == "phone:5:22"
    assert all(got[i]["base"] == got[i]["spans"] == "" for i in (5, 6, 7, 8))


def test_quality(spark):
    good = [(i, " ".join(f"w{(i * 7 + j * j) % 211}" for j in range(60)), "en", f"s{i % 3}") for i in range(80)]
    bad = [(100 + i, "BUY!! NOW!! " * 30, "en", f"s{i % 3}") for i in range(40)]
    docs = spark.createDataFrame([*good, *bad, (500, None, None, None), (501, "", "en", "s0")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(0, 60), *range(100, 130)]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.judged(docs, labels).collect()}
    assert len(got) == 122 and all(got[i] for i in range(60, 80)) and not any(got[i] for i in range(130, 140))
    assert all(r["keep"] for r in quality.judged(docs, labels.where("false")).collect())


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    assert got == mixing.mix(docs).collect() and {r["doc_id"] for r in got} <= {i for i, _ in texts()}
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.mix(many, spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")).groupBy("source").count().collect()}
    assert abs(n["a"] - 2000) < 200 and abs(n["b"] - 2000) < 200


def test_url_filter(spark):
    rows = [(1, "http://WWW.example.com/en/x?y"), (2, "https://a.example.com/en/"), (3, "ftp://example.com/de"), (4, None), (5, "no scheme"), (6, "http://net/es/"), (7, "http://xnet/es/"), (8, "http://bad.org/p/?q"), (9, "http://bad.org/p"), (9, "http://bad.org/p"), (10, "http://exampleXcom/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.judge(pages, rules, spark.createDataFrame([("http://bad.org/p/",)], "url string")).collect())
    assert got == [
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/", "example.com/en/", "block"), (3, "example.com", "/de", "com/", "allow"), (4, "", "", "", "allow"), (5, "", "", "", "allow"),
        (6, "net", "/es/", "net/es/", "block"), (7, "xnet", "/es/", "", "allow"), (8, "bad.org", "/p/", "", "block"), (9, "bad.org", "/p", "", "block"), (9, "bad.org", "/p", "", "block"), (10, "examplexcom", "/", "", "allow"),
    ]


def test_columns_of_any_name(spark, docs):
    """Columns that have the names an operator uses inside pass unchanged."""
    names = ["_url", "_entry", "_h", "_e", "_at", "_one", "_source", "_rate", "_row_key", "_first", "_last", "_doc", "_key", "_bad", "_copy", "row", "part", "share", "dims", "component_id", "host", "a.b"]
    odd = docs.withColumns({n: F.lit(f"kept {n}") for n in names}).withColumn("url", F.lit("http://a.example.com/en/"))
    benchmark = spark.createDataFrame([(1, " ".join(BASE[40:60]))], "item_id long, text string")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    for out in (mixing.mix(odd, spark.createDataFrame([("s0", 1.0), ("s1", 1.0)], "source string, weight double")), decontamination.clean(odd, benchmark), substrings.removed(odd), url_filter.judge(odd, rules), jaccard.classes(odd), jaccard.distinct(odd), tokens.encoded(odd, queries.tokenizer_path())):
        rows = out.collect()
        assert rows and all(r[n] == f"kept {n}" for r in rows for n in names if n in out.columns and n not in ("host", "component_id"))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.classes(docs).count() == 0 and jaccard.distinct(docs).count() == 0
    assert substrings.removed(docs).count() == 0
    assert tokens.encoded(docs, queries.tokenizer_path()).count() == 0
    assert mixing.mix(docs).count() == 0
    assert quality.judged(docs, labels).count() == 0
    assert decontamination.overlaps(docs, benchmark).count() == 0
    assert pii.find(docs, pii.train(docs)).count() == 0
    assert bitslices.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_encoder_of_odd_texts():
    """Pieces give the ids of whole texts, whatever white space is in them, with a fresh cache and a small one."""
    encoder = tokens.Encoder(queries.tokenizer_path())
    given = ["", " ", "  a", "a ", "a  b", "x\n y", "\n", "é  b", "don't stop 's", "a\tb c\x1c d", " lead", "ends\n", "ß ünï 日本 語", "a  b", "a " * 5, "q\r\n\r\n z", "a b a b"]
    for _ in range(2):
        n, ids = encoder(given)
        wanted = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in given]
        assert n.tolist() == [len(w) for w in wanted] and ids.tolist() == sum(wanted, [])
        encoder.rest(5)
    assert [len(x) for x in encoder([])] == [0, 0]
