"""Benchmark decontamination: spaced seeds joined between benchmark and training texts, then verified overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .arrays import chunks, lists, longs, mix, split
from .storage import bounded_batches, free, saved

#: Positions of the words that count. Together they meet every window of 13 words with two substitutions, and of 8 with one.
MASKS = ("111111", "11101011", "11010111")
#: Words of an overlap; items with fewer words must match as a whole.
OVERLAP = 13
#: Items with fewer words are too short to tell and are not looked for.
SHORTEST = 8
#: Rows of benchmark seeds, items and contaminated documents that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Words from the first hit of a stretch to its last, at most; a longer one is cut, with enough words on either side for any overlap around a hit.
STRETCH = 256
_SPAN = max(map(len, MASKS))


def substitutions(words: int) -> int:
    """How many words of an overlap may differ: 2 of 13, 1 of 8 to 12."""
    return 2 if words >= OVERLAP else 1


def _seeds(h: np.ndarray, of_end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask, the words at which it fits and its hashes there; of_end is the end of each word's text."""
    at = np.arange(len(h))
    for m, mask in enumerate(MASKS):
        fits = np.flatnonzero(at + len(mask) <= of_end)
        s = np.full(len(fits), m + 1, np.uint64)
        for i, kept in enumerate(mask):
            if kept == "1":
                s = mix(s, h[fits + i])
        yield m, fits, s


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, words) and (seed, item_id, item_at)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            w = split(data, offsets, lower=True)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), lists(w.hashes().view(np.int64), w.n)], ["item_id", "words"])

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            words = rows.column(1)
            of, h = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False).view(np.uint64)
            of = of - of[0]
            item = np.repeat(np.arange(rows.num_rows), np.diff(of))
            for _, at, s in _seeds(h, of[1:][item]):
                yield pa.RecordBatch.from_arrays([longs(s), rows.column(0).take(pa.array(item[at])), pa.array(at - of[:-1][item[at]])], ["seed", "item_id", "item_at"])

    items = saved(benchmark.select("item_id", "text").mapInArrow(hashed, "item_id long, words array<long>").where(F.size("words") >= SHORTEST).dropDuplicates(["item_id", "words"]), "items")
    return items, saved(items.mapInArrow(seeded, "seed long, item_id long, item_at long"), "seeds")


def _segments(docs: DataFrame, filter_) -> DataFrame:
    """(row_key, doc_id, start, words, seeds, at): stretches of a text around possible hits, with the hits."""
    around = OVERLAP

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            w = split(data, offsets, lower=True)
            h = w.hashes()
            end = np.repeat(w.of[1:], w.n)
            found = [(at[i], s[i]) for _, at, s in _seeds(h, end) for i in [np.flatnonzero(bloom.may_hold(filter_.value, s))]]
            at, seeds = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, seeds = at[order], seeds[order]
            row = np.searchsorted(w.of, at, "right") - 1
            far = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 2 * around + _SPAN)])
            piece = (at - at[np.flatnonzero(far)][np.cumsum(far) - 1]) // STRETCH
            far[1:] |= piece[1:] != piece[:-1]
            first = np.flatnonzero(far)
            last = np.append(first[1:], len(at)) - 1
            r = row[first]
            start = np.maximum(at[first] - around, w.of[:-1][r])
            stop = np.minimum(at[last] + _SPAN + around, w.of[1:][r])
            words = np.concatenate([h[a:z] for a, z in zip(start, stop, strict=True)])
            n = np.diff(np.append(first, len(at)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(2).take(pa.array(r)), rows.column(0).take(pa.array(r)).cast(pa.int64()), pa.array(start - w.of[:-1][r]), lists(words.view(np.int64), stop - start), lists(seeds.view(np.int64), n), lists(at - np.repeat(start, n), n)],
                ["row_key", "doc_id", "start", "words", "seeds", "at"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row_key")).mapInArrow(emit, "row_key long, doc_id long, start long, words array<long>, seeds array<long>, at array<long>")


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verify each (stretch, item) with its diagonals: the window of the overlap's length with the most equal words, the earliest of these."""
    for batch in batches:
        at, n, equal = [], [], []
        for words, item, diagonals in zip(batch.column(3), batch.column(5), batch.column(6), strict=True):
            d, t = words.values.to_numpy(zero_copy_only=False), item.values.to_numpy(zero_copy_only=False)
            long = min(OVERLAP, len(t))
            best = (0, 0)
            for k in diagonals.values.to_numpy().tolist():
                a, z = max(0, k), min(len(d), k + len(t))
                if z - a < long:
                    continue
                same = np.concatenate([[0], np.cumsum(d[a:z] == t[a - k : z - k])])
                sums = same[long:] - same[:-long]
                i = int(np.argmax(sums))
                best = max(best, (int(sums[i]), -(a + i)))
            equal.append(best[0]), at.append(-best[1]), n.append(long)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(at, np.int64) + batch.column(2).to_numpy()), batch.column(4), pa.array(n, pa.int64()), pa.array(equal, pa.int64())], ["row_key", "doc_id", "doc_at", "item_id", "n_words", "n_equal"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row_key, doc_id, item_id, doc_at, n_words, n_equal): one row for each document and benchmark item that overlap.

    docs: (doc_id, text); benchmark: (item_id, text).  Words are maximal runs
    outside ``\\x20 \\x09-\\x0D``, A-Z lower-cased.  A document and an item overlap
    when 13 consecutive words of both, word for word, differ in two places at most;
    of items with 8 to 12 words all words must be there, with one difference at
    most.  Items with fewer words, or null, are not looked for.  doc_at is the first
    word of the best window, the earliest of equals.  Null texts overlap with
    nothing.  Rows with equal text give equal rows; repeated rows with the same
    doc_id and text give one.

    Seeds are joined by hash.  The scan drops all places whose seeds a Bloom filter
    of the benchmark's seeds doesn't hold, so only stretches around possible hits
    are shuffled; the benchmark's side is broadcast only up to BROADCAST_ROWS rows.
    """
    bounded_batches(docs.sparkSession)
    items, seeds = _items(benchmark)
    n = seeds.count()
    small = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    blocks = bloom.blocks_for(n)
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom.collected(bloom.build(seeds, F.col("seed"), blocks), blocks))
    segments = saved(_segments(docs, filter_).dropDuplicates(["row_key", "doc_id", "start"]), "segments")
    hits = segments.select("row_key", "doc_id", "start", F.explode(F.arrays_zip("seeds", "at")).alias("hit")).select("row_key", "doc_id", "start", F.col("hit.seeds").alias("seed"), F.col("hit.at").alias("at"))
    diagonals = saved(hits.join(small(seeds, n), "seed").select("row_key", "doc_id", "start", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).groupBy("row_key", "doc_id", "start", "item_id").agg(F.collect_set("diagonal").alias("diagonals")), "diagonals")
    d = diagonals.withColumnRenamed("doc_id", "_d").withColumnRenamed("row_key", "_k").withColumnRenamed("start", "_s")
    placed = d.join(segments.select("row_key", "doc_id", "start", "words"), (F.col("_k") == F.col("row_key")) & F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_s") == F.col("start")))
    placed = placed.join(small(items.withColumnRenamed("words", "item"), n), "item_id").select("row_key", "doc_id", "start", "words", "item_id", "item", "diagonals")
    judged = placed.mapInArrow(_best, "row_key long, doc_id long, doc_at long, item_id long, n_words long, n_equal long")
    allowed = F.when(F.col("n_words") >= OVERLAP, substitutions(OVERLAP)).otherwise(substitutions(SHORTEST))
    hit = judged.where(F.col("n_equal") >= F.col("n_words") - allowed)
    best = F.max(F.struct("n_equal", (-F.col("doc_at")).alias("_at"), "n_words")).alias("b")
    return hit.groupBy("row_key", "doc_id", "item_id").agg(best).select("row_key", "doc_id", "item_id", (-F.col("b._at")).alias("doc_at"), F.col("b.n_words").alias("n_words"), F.col("b.n_equal").alias("n_equal"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap with no benchmark item, all columns as they are, whatever their names."""
    bad, key = free(docs, "_bad", "_row_key")
    found = saved(overlaps(docs, benchmark).select(F.col("row_key").alias(bad)).distinct(), "contaminated")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return docs.withColumn(key, F.xxhash64("text")).join(found, F.col(key) == F.col(bad), "left_anti").drop(key)
