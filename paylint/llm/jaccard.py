"""N-gram Jaccard join: prefix filters under several global token orders, exact verification, link components.

Nodes are distinct shingle sets, so exact copies cost nothing beyond the first.
Tokens (64-bit hashes of shingles) have a frequency class; every order sorts by
class first and by a hash of its own second, so rare shingles come first.  For a
similarity of t, two sets that link share one of their first n - ceil(t n) + 1
tokens under EVERY order.

1.  One pass over the texts gives each document's set size and set id, and counts
    frequent shingles.
2.  A second pass emits the prefix tokens of order 1 with their position.  In the
    bucket of a token, each set is compared with the bucket's leader only (the set
    with the most frequent shingles, which tends to be the original of a family).
3.  Pairs pass the length filter, the position filter, the prefix filters of orders
    2 and 3, and are then verified exactly.  Verified links give components.
4.  What is left of a bucket are pairs across components.  They are enumerated
    exactly, but only from sets outside the leader's component, and only against
    the lengths that the position filter leaves open: a family of n near copies
    costs about n comparisons, not n squared, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .arrays import chunks, lists, longs, mix, ngrams, split
from .components import components
from .storage import bounded_batches, dropped, free, saved

WORDS = 5
#: Similarity in percent.
SIMILAR = 80
#: Frequent shingles whose class is known to every task, at most; the order of tokens, not the result, depends on it.
FREQUENT = 1 << 21
#: A task reports shingles it has seen in this many texts.
SEEN = 2
_SEEDS = [np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179), np.uint64(0x6A09E667F3BCC908)]
#: Bits of a parity bitmap.
PARITY = 2048
_S32 = np.uint64(32)
#: Width of the length bands of step 4.
BAND = 1.05
#: A list of rows to drop is broadcast up to this many; a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted hashes."""
    w = split(data, offsets, lower=True)
    h = w.hashes()
    g = ngrams(h, words) if len(h) else h
    for a, z in zip(w.of[:-1].tolist(), w.of[1:].tolist(), strict=True):
        if z - a >= words:
            s = np.sort(g[a : z - words + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif z > a:
            yield ngrams(h[a:z], z - a)[:1]
        else:
            yield h[:0]


def _set_id(s: np.ndarray) -> int:
    total = np.array([mix(s).sum(dtype=np.uint64)], np.uint64)
    return int(mix(total, np.uint64(len(s))).view(np.int64)[0])


class _Order:
    """Token orders: by frequency class, then by hash."""

    def __init__(self, tokens: np.ndarray, classes: np.ndarray):
        self.tokens, self.classes = tokens, classes

    def of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(s), np.uint64)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.classes[at], 0).astype(np.uint64)

    @staticmethod
    def key(s: np.ndarray, classes: np.ndarray, i: int) -> np.ndarray:
        return (classes << np.uint64(58)) | (mix(s, _SEEDS[i]) >> np.uint64(6))


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    return n - -(-n * similar // 100) + 1


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """kind 0: (id = doc_id, own, n = set size, key = set id) of each row of docs (doc_id, text, own); kind 1: (n = texts, key = shingle) of what a task saw often."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_tokens, often_counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        copies: set[int] = set()
        for rows, data, offsets in chunks(batches, "text"):
            sets = list(_sets(data, offsets, words))
            ids = [_set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int8)), rows.column(0).cast(pa.int64()), rows.column(2), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(ids, pa.int64())], ["kind", "id", "own", "n", "key"])
            new = [s for s, i in zip(sets, ids, strict=True) if i is not None and i not in copies]
            copies.update(i for i in ids if i is not None)
            if new:
                s = np.sort(np.concatenate(new))
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                n = np.diff(np.append(first, len(s)))
                often_tokens.append(s[first[n > 1]])
                often_counts.append(n[n > 1])
                if len(often_tokens) > 64:
                    often_tokens, often_counts = map(list, zip(_summed(often_tokens, often_counts), strict=True))
        t, n = _summed(often_tokens, often_counts)
        t, n = t[n >= SEEN], n[n >= SEEN]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), np.int8)), pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.int64()), pa.array(n), longs(t)], ["kind", "id", "own", "n", "key"])

    return docs.select("doc_id", "text", "own").mapInArrow(profile, "kind byte, id long, own long, n long, key long")


def _summed(tokens: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t, at = np.unique(np.concatenate(tokens), return_inverse=True)
    return t, np.bincount(at, np.concatenate(counts), len(t)).astype(np.int64)


def _order(profiled: DataFrame):
    """The classes of the most frequent shingles, FREQUENT at most, as a broadcast of at most 9 bytes each."""
    often = profiled.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    tokens = often.column("key").to_numpy().view(np.uint64)
    classes = np.minimum(np.log2(np.maximum(often.column("n").to_numpy(), 1)).astype(np.uint64), 62)
    at = np.argsort(tokens)
    return profiled.sparkSession.sparkContext.broadcast((tokens[at], classes[at].astype(np.uint8)))


def _prefixes(docs: DataFrame, order, words: int, similar: int) -> DataFrame:
    """(token, sid, facts): the prefix tokens of each set under order 1; a task emits a set once.

    facts packs the set size (28 bits), the token's position (26) and how frequent the set's shingles are (10).
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, copies = _Order(*order.value), set()
        for _, data, offsets in chunks(batches, "text"):
            tokens, facts, sids, sizes = [], [], [], []
            for s in _sets(data, offsets, words):
                if not len(s) or (sid := _set_id(s)) in copies:
                    continue
                copies.add(sid)
                c = o.of(s)
                key, p = o.key(s, c, 0), prefix_length(len(s), similar)
                at = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
                at = at[np.argsort(key[at])]
                typical = np.uint64(min(1023, int(c.mean() * 64)))
                tokens.append(s[at])
                facts.append((np.uint64(len(s)) << np.uint64(36)) | (np.arange(p, dtype=np.uint64) << np.uint64(10)) | typical)
                sids.append(sid)
                sizes.append(p)
            if tokens:
                yield pa.RecordBatch.from_arrays([longs(np.concatenate(tokens)), pa.array(np.repeat(np.array(sids, np.int64), sizes)), longs(np.concatenate(facts))], ["token", "sid", "facts"])

    return docs.select("text").mapInArrow(emit, "token long, sid long, facts long")


def _possible(n: str, r: str, m: str, q: str, similar: int) -> str:
    """Length and position filter for sets of n and m tokens that first share a token at r and q."""
    return f"100 * least({n}, {m}) >= {similar} * greatest({n}, {m}) and {100 + similar} * least({n} - {r}, {m} - {q}) >= {similar} * ({n} + {m})"


def _chosen(docs: DataFrame, profiled: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text) of at least one document of each wanted set: a Bloom filter of the documents' ids goes to the scan."""
    first = profiled.where("kind = 0").groupBy(F.col("key").alias("sid")).agg(F.min("id").alias("doc_id"))
    ids = saved(first.join(wanted, "sid", "left_semi").select("doc_id"), "ids")
    blocks = bloom.blocks_for(ids.count())
    h = F.xxhash64(F.col("doc_id").cast("long"))
    return bloom.possible(docs.select("doc_id", "text"), h, bloom.build(ids, h, blocks), blocks).select("text")


def _parity(s: np.ndarray) -> np.ndarray:
    """A bitmap with a bit for whether an odd number of tokens fall on it."""
    odd = np.bincount((mix(s, _SEEDS[0]) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()


def _joined(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs with the columns of both sets, as <column>_a and <column>_b."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.withColumnsRenamed({c: end if c == "sid" else f"{c}_{end}" for c in nodes.columns}), end)
    return pairs


def _verified(pairs: DataFrame, docs: DataFrame, profiled: DataFrame, order, words: int, similar: int) -> DataFrame:
    """The pairs (a, b) of set ids that link.

    The prefixes under orders 2 and 3 come first, cut to 32 bits, with a parity
    bitmap (sets whose bitmaps differ in d bits differ in d tokens at least); only
    pairs that pass all of them have their whole sets built and compared.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = _Order(*order.value)
        for _, data, offsets in chunks(batches, "text"):
            sids, sizes, prefixes, parities = [], [], ([], []), []
            for s in _sets(data, offsets, words):
                if len(s):
                    c, p = o.of(s), prefix_length(len(s), similar)
                    for i, held in enumerate(prefixes):
                        key = o.key(s, c, i + 1)
                        held.append((s[np.argpartition(key, p - 1)[:p] if p < len(s) else slice(None)] >> _S32).astype(np.uint32).view(np.int32))
                    sids.append(_set_id(s))
                    sizes.append(len(s))
                    parities.append(_parity(s))
            if sids:
                p = np.array([len(x) for x in prefixes[0]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(sids, np.int64)), pa.array(np.array(sizes, np.int64)), *(lists(np.concatenate(x), p) for x in prefixes), lists(np.concatenate(parities), np.full(len(sids), PARITY // 64))], ["sid", "n", "second", "third", "parity"]
                )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in chunks(batches, "text"):
            if sets := [s for s in _sets(data, offsets, words) if len(s)]:
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_set_id(s) for s in sets], np.int64)), lists(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]))], ["sid", "tokens"])

    wanted = saved(_ends(pairs), "wanted")
    rows = _chosen(docs, profiled, wanted).mapInArrow(sketch, "sid long, n long, second array<int>, third array<int>, parity array<long>")
    sketches = saved(rows.join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "sketches")
    differ = F.expr("aggregate(zip_with(parity_a, parity_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    # with d tokens in one set only, (n_a + n_b - d) / 2 are common
    near = (100 + similar) * (F.col("n_a") + F.col("n_b") - differ) >= 2 * similar * (F.col("n_a") + F.col("n_b"))
    left = saved(_joined(pairs, sketches).where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b") & near).select("a", "b"), "candidates")
    dropped(sketches)
    wanted = saved(_ends(left), "wanted")
    nodes = saved(_chosen(docs, profiled, wanted).mapInArrow(build, "sid long, tokens array<long>").join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "nodes")
    common = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    links = saved(_joined(left, nodes).where(100 * common >= similar * (F.size("tokens_a").cast("long") + F.size("tokens_b") - common)).select("a", "b"), "links")
    dropped(nodes)
    return links


def classes(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Words are maximal runs outside ``\\x20 \\x09-\\x0D``, A-Z lower-cased.  A set has
    the distinct shingles of `words` words; a text with fewer words has one shingle,
    all its words; a null or empty text has none and links with nothing.  Rows with
    100 * common >= similar * union link; component_id is the smallest doc_id that
    links reach.  Repeated rows repeat in the result; a null doc_id takes the
    smallest id of its component, or null; other columns are not looked at.
    Shingles are compared by 64-bit hashes.
    """
    found = _labelled(docs.select("doc_id", "text", F.lit(0).cast("long").alias("own")), words, similar)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def _labelled(docs: DataFrame, words: int, similar: int) -> DataFrame:
    """(id, own, n, component_id, label) for each row of docs (doc_id, text, own); label tells components apart, also those without an id."""
    bounded_batches(docs.sparkSession)
    profiled = saved(profiles(docs, words), "profiles")
    order = _order(profiled)
    dealt = _prefixes(docs, order, words, similar).repartition("token")
    facts = {"n": "shiftright({0}, 36)", "r": "shiftright({0}, 10) & 67108863"}
    score = F.expr("shiftleft(facts & 1023, 40) | (xxhash64(sid) & 1099511627775)")
    leaders = dealt.groupBy("token").agg(F.max_by("sid", score).alias("lead"), F.max_by("facts", score).alias("lead_facts"), F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi")
    rows = dealt.join(leaders, "token").selectExpr("token", "sid", f"{facts['n'].format('facts')} as n", f"{facts['r'].format('facts')} as r", "lead", f"{facts['n'].format('lead_facts')} as lead_n", f"{facts['r'].format('lead_facts')} as lead_r")
    rows = saved(rows, "buckets")
    stars = saved(rows.where("sid != lead and " + _possible("n", "r", "lead_n", "lead_r", similar)).selectExpr("least(sid, lead) as a", "greatest(sid, lead) as b").distinct(), "stars")
    links = _verified(stars, docs, profiled, order, words, similar)
    rest = saved(_across(rows, components(links), similar).join(stars, ["a", "b"], "left_anti"), "across")
    links = links.union(_verified(rest, docs, profiled, order, words, similar))
    found = components(links)
    least = profiled.where("kind = 0 and key is not null").groupBy(F.col("key").alias("sid")).agg(F.min("id").alias("least"))
    named = least.join(found.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("label", "sid").alias("label"))
    named = saved(named, "named")
    by_label = saved(named.groupBy("label").agg(F.min("least").alias("component_id")), "smallest")
    by_set = saved(named.join(by_label, "label").select(F.col("sid").alias("key"), "component_id", "label"), "sets")
    rows = profiled.where("kind = 0").join(by_set, "key", "left")
    return rows.select("id", "own", "n", F.coalesce("component_id", "id").alias("component_id"), "label")


def distinct(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """docs (doc_id, text, any others) with one row of each group that links connect: that with the smallest doc_id.

    A null doc_id comes after all others; of rows with equal doc_id and different
    texts that with the smaller hash of both stays.  Of rows with equal doc_id and
    text one stays, whichever comes first in the order of a shuffle.  Rows without
    words link with nothing, so all of them stay, repeated ones too.  Rows are told
    apart by doc_id and a hash of doc_id and text, never by doc_id alone.
    """
    own, other, link = free(docs, "_own", "_other", "_link")
    keyed = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    found = saved(_labelled(keyed.select("doc_id", "text", F.col(own).alias("own")), words, similar).where("n > 0").select("id", "own", "component_id", "label"), "classes")
    # the smallest identifier decides but where rows share it, or where a group has none
    shared = found.where("id = component_id").groupBy("id").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most")
    led = found.where("id is not null").join(shared.select(F.col("id").alias("_id"), "least"), F.col("id") == F.col("_id"), "left").select("id", "own", F.expr("component_id < id or own != coalesce(least, own)").alias("drop"))
    bare = found.where("id is null").groupBy("label").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most").select(F.col("label").alias("_label"), "least")
    bare = found.where("id is null").join(bare, F.col("label") == F.col("_label"), "left").select("id", "own", F.expr("component_id is not null or own != coalesce(least, own)").alias("drop"))
    # only rows to drop, and those that stay but are repeated, are listed
    counted = led.union(bare).groupBy("id", "own", "drop").agg(F.count(F.lit(1)).alias("n")).where("drop or n > 1")
    listed = saved(counted.select(F.col("own").alias(other), F.col("id").alias(link), "drop"), "listed")
    same = F.col(own).eqNullSafe(F.col(other)) & F.col("doc_id").eqNullSafe(F.col(link))

    def rows(which: str, how: str) -> DataFrame:
        some = listed.where(which).select(other, link)
        some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
        return keyed.join(some, same, how).select(*(F.col(f"`{c}`") for c in keyed.columns))

    single = rows("true", "left_anti").drop(own)
    return single.unionByName(rows("not drop", "left_semi").dropDuplicates(["doc_id", "text"]).drop(own))


def _across(rows: DataFrame, found: DataFrame, similar: int) -> DataFrame:
    """The pairs of a bucket's sets that are in different components and pass the filters, found from the sets outside the leader's component."""
    of = found.select(F.col("node"), "label")
    labelled = rows.join(of.withColumnRenamed("node", "sid"), "sid", "left").withColumn("c", F.coalesce("label", "sid")).drop("label")
    labelled = labelled.join(of.select(F.col("node").alias("lead"), F.col("label").alias("lc")), "lead", "left").withColumn("lc", F.coalesce("lc", "lead"))
    mixed = saved(labelled.select("token", "sid", "n", "r", "c", "lc"), "labelled")
    band = lambda x: f"cast(floor(ln({x}) / ln({BAND})) as int)"
    # y of m tokens may link with x only if similar * m <= (100 + similar) * (n - r) - similar * n
    outer = mixed.where("c != lc").withColumn("most", F.expr(f"least(n * 100 / {similar}, ({100 + similar} * (n - r) - {similar} * n) / {similar}) + 0.5")).where(f"100 * most >= {similar} * n")
    outer = outer.select("token", F.col("sid").alias("x"), F.col("n").alias("xn"), F.col("r").alias("xr"), F.col("c").alias("xc"), F.explode(F.expr(f"sequence({band(f'greatest(1, n * {similar} / 100 - 0.5)')}, {band('most')})")).alias("band"))
    inner = mixed.join(outer.select("token").distinct(), "token", "left_semi").select("token", F.col("sid").alias("y"), F.col("n").alias("yn"), F.col("r").alias("yr"), F.col("c").alias("yc"), F.expr(band("n")).alias("band"))
    pairs = outer.join(inner, ["token", "band"]).where("xc != yc and " + _possible("xn", "xr", "yn", "yr", similar))
    return pairs.selectExpr("least(x, y) as a", "greatest(x, y) as b").distinct()
