"""Personal data: the fixed patterns against their literal form, the field's accuracy on unseen mentions, odd rows."""

import random
import re

import pyarrow as pa
import pytest

from paylint.llm import arrays, pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    def counts(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), list(PATTERNS).index(k), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if counts(k, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0"))


def test_patterns_of_random_texts(spark, field):
    rng = random.Random(5)
    parts = ["1", "22", "255", "256", ".", "..", "-", " ", "@", "a", "b-1", "+", "+1", "(", ")", "é", "\n", "4111 1111 1111 1111", "10.0.0.1", "x@y.z", "+1 (800) 555-0100", "日本"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(4000)] + [(-1, None), (-2, ""), (-3, "9" * 60_000), (-4, "1 " * 60_000), (-5, "(" * 30_000), (-6, "a@b" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(docs, field).collect()}
    for i, text in rows:
        assert found[i]["base"] == plain_base(text), text
        base, every = found[i]["base"].split(","), found[i]["spans"].split(",")
        assert found[i]["base"] == "" or set(base) <= set(every)
        assert len([x for x in every if x]) == len([x for x in base if x]) + found[i]["n_added"]


def test_every_document(spark):
    """All base spans of a given table are those of the patterns, and the field adds to them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = pii.find(docs, pii.train(docs)).collect()
    assert all(r["base"] == plain_base(texts[r["doc_id"]]) for r in found) and sum(r["n_added"] for r in found) > 0
    assert len(queries.op9_pii_crf(spark, "/root/testdata/sf0.001").collect()) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


#: Mentions that are not in the labelled table, with the kind that is to be found, or None.
UNSEEN = [
    ("token = \"{hex40}\"", "secret"), ("api_key: {hex40}", "secret"), ("secret = {mixed24}", "secret"), ("password: {mixed24}", "secret"), ("access token {mixed24}", "secret"),
    ("call ({d3}) 555-{d4}", "phone"), ("phone {d3}-555-{d4}", "phone"), ("tel: 0{d3}{d3}{d3}", "phone"), ("mobile 0{d2}-{d4}-{d4}", "phone"),
    ("mail {w} (at) {w} (dot) org", "email"), ("contact: {w}.{w} [at] example [dot] com", "email"),
    ("page {d2} of {d3}", None), ("in 19{d2} and 20{d2} the", None), ("order {d4}{d4} was", None), ("version {d1}.{d2}.{d1} of", None), ("(see note {d1}) and", None), ("total {d1},{d3}.{d2} for {d2} units", None), ("| {d2} | {d3} |", None), ("x = {d2} and", None),
]


def test_unseen_mentions(spark, field):
    """Precision and recall on mentions with new contents in words of documents that the field has not seen."""
    rng = random.Random(6)
    around = pii.contexts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1"), windows=400)
    made = {"d1": lambda: str(rng.randrange(1, 9)), "d2": lambda: str(rng.randrange(10, 99)), "d3": lambda: str(rng.randrange(100, 999)), "d4": lambda: str(rng.randrange(1000, 9999)), "w": lambda: rng.choice(["anna", "li", "maxim", "office"]),
            "hex40": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), "mixed24": lambda: "".join(rng.choice("0123456789abcdefghijXYZ") for _ in range(22)) + "7q"}
    texts, wanted = [], []
    for i, words in enumerate(around):
        form, kind = UNSEEN[i % len(UNSEEN)]
        mention = re.sub(r"\{(\w+)\}", lambda m: made[m[1]](), form)
        texts.append(" ".join(words[:8] + [mention] + words[8:]))
        wanted.append(kind)
    data, offsets = arrays.utf8(pa.array(texts))
    w = arrays.split(data, offsets)
    found = [set() for _ in texts]
    for text, a, z, kind in pii._added(field, w, pii.MARGIN):
        span = data[w.start[a] : w.end[z - 1]].tobytes().decode()
        if pii._checked(kind, pii._core(kind, span)[1]):
            found[text].add(pii.ALL[kind])
    right = sum(k in f for f, k in zip(found, wanted) if k)
    said, there = sum(map(len, found)), sum(k is not None for k in wanted)
    assert right >= 0.85 * there and right >= 0.95 * said, (right, said, there)


def test_without_documents(spark):
    """An empty table, and a labelled table of one's own."""
    docs = spark.createDataFrame([], "doc_id long, text string")
    own = spark.createDataFrame([("badge <secret>AB-12-CD-34-EF</> shown",), ("plain words",), (None,)], "text string")
    assert pii.find(docs, pii.train(docs, own)).count() == 0
    one = spark.createDataFrame([(1, "words and badge XY-98-ZW-76-UV shown")], "doc_id long, text string")
    assert pii.find(one, pii.train(docs, own)).first()["spans"] == "secret:16:30"
