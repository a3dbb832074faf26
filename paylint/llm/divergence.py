"""Source divergence audit: how far the sources of a language differ in their terms, and by which terms.

Counting shuffles digests of terms, of fixed width.  The strings stay in the table
that each task has written, each string once a task; of the kept digests alone the
smallest and the largest string are looked up, where they differ the digest is split by its strings, and
other strings are joined back only for the rows that are returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .arrays import Words, chunks, give_back, split
from .storage import bounded_batches, saved

#: A term of at least so many documents of a language is kept.
LEAST = 3
#: Probabilities are whole parts of this.
SCALE = 1_000_000_000
#: Terms reported for a group.
TOP = 200
#: Counts that a task holds before it sums and writes them.
HELD = 3_000_000
#: Splits of the input that one task reads, where there are more splits than cores.
SPLITS = 3
#: Counts of terms by source that one task compares at a time, about.
ENTRIES = 200_000
#: Sources that one task compares with all others of their language.
BLOCK = 256
#: Tables of groups of at most this many rows are broadcast, longer ones are shuffled.
BROADCAST_GROUPS = 100_000
#: Sets of digests to split of at most so many are given to each task; with more, tasks write all their strings.
SPLIT = 1_000_000

#: Bytes outside terms: all but letters A-Z and a-z and bytes of characters outside ASCII.
_OTHER = np.ones(256, bool)
_OTHER[65:91] = _OTHER[97:123] = _OTHER[128:] = False

_ROW = "lang string, source string, digest long, n long, docs long, term string"


class _Held:
    """Counts by digest and group, and the strings of digests, of some chunks of texts."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.groups: dict[tuple[str, str], int] = {}
        self.counts: list[tuple[np.ndarray, ...]] = []
        self.strings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def terms(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        w = split(data, offsets, lower=True, separator=_OTHER)
        return w, w.hashes() >> self.shift

    def group(self, langs: list[str], sources: list[str]) -> np.ndarray:
        return np.array([self.groups.setdefault(k, len(self.groups)) for k in zip(langs, sources, strict=True)], np.int64)

    def add(self, langs: list[str], sources: list[str], data: np.ndarray, offsets: np.ndarray) -> None:
        w, h = self.terms(data, offsets)
        if not len(h):
            return
        group = self.group(langs, sources)
        doc = np.repeat(np.arange(len(group)), w.n)
        # terms of a group's documents next to each other, then stably by digest: each digest's by group and document
        by_group = np.argsort(group, kind="stable")
        place = np.empty(len(group), np.int64)
        place[by_group] = np.arange(len(group))
        order = np.argsort(place[doc], kind="stable")
        order = order[np.argsort(h[order], kind="stable")]
        h, doc, of = h[order], doc[order], group[doc[order]]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_group = new_h | np.concatenate([[True], of[1:] != of[:-1]])
        new_doc = new_group | np.concatenate([[True], doc[1:] != doc[:-1]])
        first = np.flatnonzero(new_group)
        self.counts.append((h[first], of[first], np.diff(first, append=len(h)), np.add.reduceat(new_doc, first, dtype=np.int64)))
        self.strings.append(_distinct(w, h, order, new_h))
        self.n += len(first)

    def compact(self) -> bool:
        """Sum counts and merge strings; whether so many remain that they are better written."""
        if self.counts:
            h, group, n, docs = (np.concatenate(c) for c in zip(*self.counts, strict=True))
            order = np.lexsort((group, h))
            h, group = h[order], group[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (group[1:] != group[:-1])]))
            self.counts = [(h[first], group[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first))]
            self.n = len(first)
            size, h, text = (np.concatenate(c) for c in zip(*self.strings, strict=True))
            end = np.cumsum(size)
            w = Words(text, end - size, end, np.array([0, len(end)]), np.array([0, len(text)]))
            order = np.argsort(h, kind="stable")
            h = h[order]
            self.strings = [_distinct(w, h, order, np.concatenate([[True], h[1:] != h[:-1]]))]
        return self.n > HELD * 2 // 3

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is held, summed; then nothing is."""
        self.compact()
        for h, group, n, docs in self.counts:
            names = list(self.groups)
            lang, source = (pa.DictionaryArray.from_arrays(pa.array(group), pa.array([k[i] for k in names])).cast(pa.string()) for i in (0, 1))
            yield from _batches([lang, source, pa.array(h.view(np.int64)), pa.array(n), pa.array(docs), pa.nulls(len(h), pa.string())])
        for size, h, text in self.strings:
            held = pa.Array.from_buffers(pa.large_string(), len(h), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(text)])
            none, zero = pa.nulls(len(h), pa.string()), pa.nulls(len(h), pa.int64())
            yield from _batches([none, none, pa.array(h.view(np.int64)), zero, zero, held.cast(pa.string())])
        self.counts, self.strings, self.n, self.groups = [], [], 0, {}


def _batches(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    for b in pa.Table.from_arrays(columns, ["lang", "source", "digest", "n", "docs", "term"]).to_batches(1 << 16):
        yield b


def _distinct(w: Words, h: np.ndarray, order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, digests, bytes) of the different words of each digest; order sorts words by digest, h are the digests in that order, new says where one begins."""
    first = np.flatnonzero(new)
    lead = np.repeat(first, np.diff(first, append=len(h)))
    others = np.flatnonzero(~w.same(order, order[lead]))
    keep = order[first]
    if len(others):
        # a digest of several words, which almost never is
        seen = {(int(h[i]), w.data[w.start[order[i]] : w.end[order[i]]].tobytes()): order[i] for i in others[::-1]}
        keep = np.concatenate([keep, np.array(list(seen.values()), np.int64)])
    digests = np.concatenate([h[first], h[others][[]] if not len(others) else np.array([k for k, _ in seen], np.uint64)])
    size = w.end[keep] - w.start[keep]
    at = np.arange(size.sum()) + np.repeat(w.start[keep] - np.cumsum(size) + size, size)
    return size, digests, w.data[at]


def term_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, source, digest, n, docs, term): summed within each task, several rows a term.

    docs: (lang, source, text), without nulls.  Rows with a term have that and its digest alone: a string
    of the digest.  Others have how often terms of a digest occur in a group, and in
    how many documents.  bits: those of a digest.
    """
    bounded_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(bits)
        for rows, data, offsets in chunks(batches, "text"):
            held.add(rows.column(0).to_pylist(), rows.column(1).to_pylist(), data, offsets)
            if held.n > HELD and held.compact():
                yield from held.rows()
        yield from held.rows()
        give_back()

    rows = docs.select("lang", "source", "text")
    # what tasks have counted is shuffled, and fewer tasks count the same terms: some splits a task, as long as each core has one
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // SPLITS)
    return rows.coalesce(tasks).mapInArrow(counted, _ROW)


def string_counts(docs: DataFrame, digests: np.ndarray | None, bits: int = 64) -> DataFrame:
    """As the counts of term_counts, by string, of terms with one of the digests, or of all."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(bits)
        for rows, data, offsets in chunks(batches, "text"):
            w, h = held.terms(data, offsets)
            at = np.arange(len(h)) if digests is None else np.flatnonzero(np.isin(h.view(np.int64), digests))
            group = held.group(rows.column(0).to_pylist(), rows.column(1).to_pylist())
            doc = np.searchsorted(w.of, at, "right") - 1
            words = [(g, d, k, w.data[a:z].tobytes()) for g, d, k, a, z in zip(group[doc].tolist(), doc.tolist(), h[at].view(np.int64).tolist(), w.start[at].tolist(), w.end[at].tolist(), strict=True)]
            n, docs = Counter((g, k, t) for g, _, k, t in words), Counter((g, k, t) for g, _, k, t in set(words))
            names = list(held.groups)
            yield from _batches([pa.array(c, t) for c, t in zip(zip(*((*names[g], k, x, docs[g, k, t], t.decode()) for (g, k, t), x in n.items()), strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]) if n else ()

    return docs.select("lang", "source", "text").mapInArrow(counted, _ROW)


def _kept(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(lang, source, keys, n): counts by group of the terms that at least `least` documents of their language hold.

    Sums combine before each shuffle, so a term that all sources have is no burden.
    """
    sums = saved(counts.groupBy("lang", "source", *keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = saved(sums.groupBy("lang", *keys).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "kept")
    n = kept.count()
    return sums.drop("docs").join(F.broadcast(kept) if n <= BROADCAST_GROUPS else kept, ["lang", *keys], "left_semi")


def _resolved(rows: DataFrame, counts: DataFrame, least: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The counts (lang, source, digest, term, n) of kept terms, and (digest, text) of those digests that one string has; term is null for these.

    A digest is kept if its strings together are frequent enough, so no kept term is
    missed.  Kept digests go into a Bloom filter, and only strings that pass it are
    shuffled.
    """
    kept = saved(_kept(counts.where("term is null"), ["digest"], least), "kept-counts")
    digests = kept.select("digest").distinct()
    blocks = bloom.blocks_for(digests.count())
    listed = bloom.build(digests, F.xxhash64("digest"), blocks)
    held = bloom.possible(counts.where("term is not null").select("digest", "term"), F.xxhash64("digest"), listed, blocks)
    # tasks have each string once; equal ones of several tasks meet by digest
    strings = held.repartition("digest").distinct().groupBy("digest").agg(F.min("term").alias("text"), F.max("term").alias("most"))
    strings = saved(strings, "strings")
    plain = kept.select("lang", "source", "digest", F.lit(None).cast("string").alias("term"), "n")
    shared = strings.where("text <> most").select("digest")
    n = shared.count()
    if not n:
        return plain, strings.select("digest", "text")
    some = shared.toArrow().column("digest").to_numpy() if n <= SPLIT else None
    exact = _kept(saved(string_counts(rows, some, bits).join(shared, "digest", "left_semi"), "string-counts"), ["digest", "term"], least)
    terms = plain.join(shared, "digest", "left_anti").unionByName(exact.select("lang", "source", "digest", "term", "n"))
    return saved(terms, "split-counts"), strings.where("text = most").select("digest", "text")


def _probability(n: str, total: str, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / total), exactly."""
    return F.expr(f"1 + (cast({n} + 1 as decimal(20, 0)) * {scale}) div {total}")


def _scaled(n: np.ndarray, total: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * n / total) for 0 < n <= total < 9e15, by long division: no product leaves 64 bits. scale: a power of 1000."""
    out, rest = n // total, n % total
    while scale > 1:
        rest = rest * 1000
        out, rest, scale = out * 1000 + rest // total, rest % total, scale // 1000
    return out


def _compared(scale: int) -> Callable:
    """For a share of a language's terms: the divergence of every source from those of one block, summed over the terms."""

    def pairs(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
        names, total = groups.column("source").combine_chunks(), groups.column("total").to_numpy()
        n, own = len(names), np.flatnonzero(groups.column("own").to_numpy(zero_copy_only=False))
        sums = np.zeros((n, len(own)), np.int64)
        base = 1 + _scaled(np.ones(n, np.int64), total, scale) if n else None
        count, col = terms.column("n").to_numpy(), pc.index_in(terms.column("source").combine_chunks(), value_set=names).to_numpy()
        # terms are numbered; a chunk of them is a dense table of probabilities
        _, term = np.unique(np.stack([terms.column("digest").to_numpy(), pc.fill_null(terms.column("term").combine_chunks(), "").dictionary_encode().indices.to_numpy()]), axis=1, return_inverse=True)
        order = np.argsort(term, kind="stable")
        count, col, term = count[order], col[order], term[order]
        step = max(1, (1 << 20) // max(1, n))
        for first in range(0, int(term[-1]) + 1 if len(term) else 0, step):
            a, z = np.searchsorted(term, [first, first + step])
            p = np.tile(base, (int(term[z - 1]) + 1 - first, 1))
            p[term[a:z] - first, col[a:z]] = 1 + _scaled(count[a:z] + 1, total[col[a:z]], scale)
            for k, h in enumerate(own.tolist()):
                q = p[:, h : h + 1]
                sums[:, k] += ((p - q) * (p - q) // q).sum(0)
        g, k = np.nonzero(np.arange(n)[:, None] != own[None, :])
        columns = [pa.array([key[0].as_py()] * len(g), pa.string()), names.take(pa.array(g)), names.take(pa.array(own[k])), pa.array(sums[g, k])]
        return pa.Table.from_arrays(columns, ["lang", "source", "item", "value"])

    return pairs


def _pairs(terms: DataFrame, groups: DataFrame, scale: int) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    entries = terms.count()
    parts = max(1, math.ceil(entries / ENTRIES))
    place = Window.partitionBy("lang").orderBy("source")
    placed = groups.withColumn("block", F.floor((F.row_number().over(place) - 1) / BLOCK).cast("int"))
    blocks = placed.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    left = terms.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_GROUPS else blocks, "lang").select("lang", F.pmod(F.xxhash64("digest", "term"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "digest", "term", "source", "n")
    wide = placed.withColumnRenamed("block", "mine").join(blocks, "lang")
    right = wide.select("lang", "source", "total", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("lang", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).alias("part"), "block", "source", "total", (F.col("mine") == F.col("block")).alias("own"))
    keys = ("lang", "part", "block")
    compared = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compared(scale), "lang string, source string, item string, value long")
    return compared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, scale: int = SCALE, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of sources, and the terms that a source has more often than its language.

    Terms are runs of letters A-Z, lower-cased, and of characters outside ASCII.  A
    language keeps the terms that `least` of its documents hold.  A group is a
    source within a language; its probability of a kept term is p = 1 + floor(scale
    (n + 1) / (N + V)), with N its occurrences of kept terms and V their number.
    Part `pair` has for each other source of the language the sum of floor((p - q)^2
    / q) over all kept terms, q the other source's probability.  Part `term` has the
    `top` terms of a group with an occurrence and p above the language's q.
    Ranks start at 1 and go by value, then by the item's bytes.

    Null texts, languages and sources are empty strings, and empty ones are groups of
    their own.  Each row is a document, repeated ones too.  Texts of any length are
    read whole.  A group without terms still has its pairs; a language with one source has none.
    An empty table gives no rows; columns other than text, lang and source don't
    matter.  bits: those of the digests that stand for terms in shuffles.
    """
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = saved(term_counts(rows, bits), "term-counts")
    terms, texts = _resolved(rows, counts, least, bits)

    of_lang = terms.groupBy("lang", "digest", "term").agg(F.sum("n").alias("lang_n"))
    of_lang = saved(of_lang, "lang-counts")
    vocabulary = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = saved(groups.select("lang", "source", (F.coalesce("total", zero) + F.coalesce("v", zero)).alias("total"), (F.coalesce("lang_total", zero) + F.coalesce("v", zero)).alias("lang_total")), "groups")
    pair = _pairs(terms, groups, scale)

    known = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    l = of_lang.select(F.col("lang").alias("_lang"), F.col("digest").alias("_digest"), F.col("term").alias("_term"), "lang_n")  # noqa: E741
    entries = terms.join(l, (F.col("lang") == F.col("_lang")) & (F.col("digest") == F.col("_digest")) & F.col("term").eqNullSafe(F.col("_term")))
    each = entries.join(known, ["lang", "source"]).select("lang", "source", "digest", "term", _probability("n", "total", scale).alias("p"), _probability("lang_n", "lang_total", scale).alias("q"))
    above = each.where("p > q").select("lang", "source", "digest", "term", F.expr("((p - q) * (p - q)) div q").alias("value"))
    # the rank keeps all ties, so that strings decide only among terms that may be reported
    best = above.withColumn("rank", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("rank") <= top).drop("rank")
    named = best.join(texts, "digest", "left").select("lang", "source", F.coalesce("term", "text").alias("item"), "value")
    named = _ranked(named).where(F.col("rank") <= top)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(_ranked(pair), "pair").unionByName(part(named, "term"))
