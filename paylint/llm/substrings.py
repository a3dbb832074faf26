"""Substring dedup: windows of words that an earlier document has, found by super-k-mer partitioning.

A window is 13 consecutive words.  Its minimiser is the smallest hash among its
runs of 4 words; neighbouring windows mostly share it, and equal windows always do.

1.  A pass over the texts emits minimisers with the documents they are in, reduced
    inside a task and again while they shuffle.  Those of one document only can't
    hold a repeated window and are done with.
2.  A second pass looks minimisers up in a Bloom filter of the rest.  Windows that
    the task itself has seen in a smaller document are decided there, so a hot
    passage leaves a task once.  What is open travels: consecutive windows sharing a
    minimiser go as one packed string of words to the minimiser's bucket.  Windows
    of a minimiser that very many documents have go one by one, dealt by their own
    hash, so such a minimiser doesn't gather in one task.
3.  In the buckets, sorting brings equal windows together, which are compared word
    by word; all but those of the smallest document are covered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .arrays import Words, chunks, lists, longs, mix, ngrams, split, utf8
from .storage import bounded_batches, free, saved

WINDOW = 13
MINIMISER = 4
#: A minimiser in more documents than this is dealt by window.
HOT = 512
#: Words whose bytes are compared at once.
COMPARED = 1 << 18
_SEED = np.uint64(0xA54FF53A5F1D36F1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    run, have = x, 1
    while have < width:
        step = min(have, width - have)
        run, have = np.minimum(run, np.concatenate([run[step:], np.full(min(step, len(run)), np.uint64(2**64 - 1))])), have + step
    return run


def _minimisers(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows and the windows' minimisers."""
    at = np.flatnonzero(w.windows(window))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    return at, _sliding_min(mix(ngrams(h, MINIMISER), _SEED), window - MINIMISER + 1)[at]


def _fingerprints(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return ngrams(h, window), ngrams(mix(h, _SEED), window)


def _equal_runs(w: Words, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run whether the n words from i on are those from j on, byte by byte."""
    out = np.ones(len(n), bool)
    ends = np.cumsum(n)
    cuts = np.searchsorted(ends, np.arange(COMPARED, ends[-1] if len(ends) else 0, COMPARED))
    for part in np.split(np.arange(len(n)), np.unique(cuts)):
        run = np.repeat(np.arange(len(part)), n[part])
        inner = np.arange(len(run)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        a, b = i[part][run] + inner, j[part][run] + inner
        long = w.end[a] - w.start[a]
        unlike = long != w.end[b] - w.start[b]
        long = np.where(unlike, 0, long)
        inner = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        bytes_ = np.repeat(run, long)[w.data[np.repeat(w.start[a], long) + inner] != w.data[np.repeat(w.start[b], long) + inner]]
        out[part] = np.bincount(np.concatenate([run[unlike], bytes_]), minlength=len(part)) == 0
    return out


def _groups(a: np.ndarray, b: np.ndarray, doc: np.ndarray, w: Words, at: np.ndarray, window: int) -> np.ndarray:
    """True where an equal window has a smaller doc; at: the windows' first words.

    Sorting by fingerprint (a, b) and doc brings equal windows together.  Each is
    compared with the first of its group word by word; neighbours that follow one
    another in both places are compared as one run.  Windows whose fingerprint is
    shared by different words are counted by their words.
    """
    if not len(a):
        return np.zeros(0, bool)
    order = np.lexsort((doc, b, a))
    sa, sb, sd = a[order], b[order], doc[order]
    new = np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])])
    group = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)][group]
    out = np.empty(len(a), bool)
    out[order] = sd > doc[first]
    # all but the first of each group against the first, in the order of their places
    later = np.flatnonzero(~new)
    later = later[np.argsort(at[order[later]], kind="stable")]
    i, j = at[order[later]], at[first[later]]
    breaks = np.ones(len(i), bool)
    breaks[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    begin, end = _runs(breaks)
    same = _equal_runs(w, i[begin], j[begin], i[end] - i[begin] + window)
    if not same.all():
        shared = np.unique(group[later[np.repeat(~same, end - begin + 1)]])
        some = order[np.isin(group, shared)]
        words = [b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[k : k + window], w.end[k : k + window], strict=True)) for k in at[some].tolist()]
        least: dict[bytes, int] = {}
        for x, d in zip(words, doc[some].tolist(), strict=True):
            least[x] = min(d, least.get(x, d))
        out[some] = [d > least[x] for x, d in zip(words, doc[some].tolist(), strict=True)]
    return out


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs that begin where breaks is true."""
    first = np.flatnonzero(breaks)
    return first, np.append(first[1:], len(breaks)) - 1 if len(first) else first


def _spread(docs: DataFrame, window: int) -> DataFrame:
    """(mini, lo, hi, n): minimisers with the smallest and largest doc_id of a chunk that has them, and in how many runs of windows they are."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            w = split(data, offsets)
            at, mini = _minimisers(w, w.hashes(), window)
            doc = np.repeat(rows.column(0).to_numpy(), w.n)[at]
            run = np.flatnonzero(np.concatenate([[True], (mini[1:] != mini[:-1]) | (doc[1:] != doc[:-1])])) if len(at) else at
            mini, doc = mini[run], doc[run]
            order = np.lexsort((doc, mini))
            mini, doc = mini[order], doc[order]
            first, last = _runs(np.concatenate([[True], mini[1:] != mini[:-1]]) if len(mini) else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([longs(mini[first]), pa.array(doc[first]), pa.array(doc[last]), pa.array(last - first + 1, pa.int64())], ["mini", "lo", "hi", "n"])

    return docs.select("doc_id", "text").mapInArrow(emit, "mini long, lo long, hi long, n long")


def _travelling(docs: DataFrame, repeated, hot, window: int) -> DataFrame:
    """(bucket, doc_id, row_key, at, words): packed super-k-mers; bucket null: words at to at + n are covered already, n in words.

    at lists the places of equal windows that a document has and that go alone, so a
    line that a text repeats leaves it once; it has one place for all others.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            w = split(data, offsets)
            h = w.hashes()
            at, mini = _minimisers(w, h, window)
            kept = np.flatnonzero(bloom.may_hold(repeated.value, mini))
            at, mini = at[kept], mini[kept]
            row = np.repeat(np.arange(rows.num_rows), w.n)[at]
            doc = rows.column(0).to_numpy()[row]
            a, b = _fingerprints(h, window) if len(h) else (h, h)
            done = _groups(a[at], b[at], doc, w, at, window)
            out = []
            for covered in (True, False):
                i = np.flatnonzero(done == covered)
                p, m, r = at[i], mini[i], row[i]
                alone = bloom.may_hold(hot.value, m)
                breaks = np.ones(len(p), bool)
                breaks[1:] = (p[1:] != p[:-1] + 1) | (r[1:] != r[:-1])
                if not covered:
                    breaks[1:] |= (m[1:] != m[:-1]) | alone[1:]
                first, last = _runs(breaks)
                begin, end = p[first], p[last] + window
                places = begin - w.of[:-1][r[first]]
                sizes = np.ones(len(first), np.int64)
                if covered:
                    bucket, packed = pa.nulls(len(first), pa.int64()), [b"%d" % n for n in (end - begin).tolist()]
                else:
                    keys = np.where(alone[first], a[p[first]], m[first])
                    # windows that go alone are put together by text and window; each has its words compared where it ends up
                    order = np.lexsort((begin, np.where(alone[first], r[first], -1 - np.arange(len(first))), keys))
                    first, begin, end, places, keys, single = first[order], begin[order], end[order], places[order], keys[order], alone[first][order]
                    new = np.ones(len(first), bool)
                    new[1:] = ~single[1:] | (keys[1:] != keys[:-1]) | (r[first][1:] != r[first][:-1]) | (b[begin][1:] != b[begin][:-1])
                    same = np.flatnonzero(~new)
                    new[same[~_equal_runs(w, begin[same], begin[same - 1], np.full(len(same), window))]] = True
                    # back in the order of the text, in which neighbours share words and compress well
                    lead, sizes = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(first)))
                    back = np.argsort(begin[lead])
                    places = places[np.argsort(np.argsort(back)[np.cumsum(new) - 1], kind="stable")]
                    lead, sizes = lead[back], sizes[back]
                    first, begin, end = first[lead], begin[lead], end[lead]
                    bucket = longs(keys[lead])
                    packed = [b" ".join(data[s:e].tobytes().split()) for s, e in zip(w.start[begin].tolist(), w.end[end - 1].tolist(), strict=True)]
                out.append(pa.RecordBatch.from_arrays([bucket, rows.column(0).take(pa.array(r[first])), rows.column(2).take(pa.array(r[first])), lists(places, sizes), pa.array(packed, pa.binary())], ["bucket", "doc_id", "row_key", "at", "words"]))
            yield from out

    return docs.select("doc_id", "text", "row_key").mapInArrow(emit, "bucket long, doc_id long, row_key long, at array<long>, words binary")


def _covered(travelling: DataFrame, window: int) -> DataFrame:
    """(doc_id, row_key, first, last): runs of words that windows of the buckets cover."""

    def judge(rows: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(rows.column(4))
        w = split(data, offsets)
        h = w.hashes()
        at = np.flatnonzero(w.windows(window))
        a, b = _fingerprints(h, window) if len(h) else (h, h)
        row = np.repeat(np.arange(rows.num_rows), w.n)[at]
        hit = np.flatnonzero(_groups(a[at], b[at], rows.column(1).to_numpy()[row], w, at, window))
        at, row = at[hit], row[hit]
        breaks = np.ones(len(at), bool)
        breaks[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
        first, last = _runs(breaks)
        places = rows.column(3)
        of, places = places.offsets.to_numpy(), places.values.to_numpy()
        n = np.diff(of)[row[first]]
        run = np.repeat(np.arange(len(first)), n)
        r = row[first][run]
        inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        begin = places[of[r] + inner] + at[first][run] - w.of[:-1][r]
        return pa.RecordBatch.from_arrays([rows.column(1).take(pa.array(r)), rows.column(2).take(pa.array(r)), pa.array(begin), pa.array(begin + (at[last] - at[first])[run] + window)], ["doc_id", "row_key", "first", "last"])

    def sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1], "left"))
            if held and (cut or held[-1].column(0)[-1].as_py() != bucket[0]):
                held.append(batch.slice(0, cut))
                yield judge(_joined(held))
                held = []
            elif cut:
                yield judge(batch.slice(0, cut))
            held.append(batch.slice(cut))
        if held:
            yield judge(_joined(held))

    dealt = travelling.where("bucket is not null").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(sorted_buckets, "doc_id long, row_key long, first long, last long")


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row_key, first, last): the word runs [first, last) of docs (doc_id, text, row_key) that earlier documents have."""
    bounded_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null and text is not null")
    minis = saved(_spread(docs, window).groupBy("mini").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo < hi").select("mini", "n"), "minimisers")
    filters = []
    for some in (minis, minis.where(F.col("n") > HOT)):
        blocks = bloom.blocks_for(some.count())
        filters.append(docs.sparkSession.sparkContext.broadcast(bloom.collected(bloom.build(some, F.col("mini"), blocks), blocks)))
    travelling = saved(_travelling(docs, *filters, window), "superkmers")
    local = travelling.where("bucket is null").select("doc_id", "row_key", F.col("at")[0].alias("first"), (F.col("at")[0] + F.col("words").cast("string").cast("long")).alias("last"))
    return local.union(_covered(travelling, window))


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) with n_words, n_removed and kept: the text's words but those of windows an earlier document has, joined by a space.

    Words are maximal runs outside ``\\x20 \\x09-\\x0D``, compared as they are.  A
    word goes if any window of `window` words over it also begins in a document with
    a smaller doc_id; all windows are judged on the input.  Texts shorter than a
    window stay.  Null texts have no words.  Rows with the same doc_id never remove
    from each other; rows with a null doc_id neither remove nor lose words.  Windows
    are sorted by hashes and compared by their words.  Columns named n_words, n_removed or kept are
    replaced.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    key, doc, own, first_, last_ = free(docs, "_row_key", "_doc", "_key", "_first", "_last")
    columns = [F.col(f"`{c}`") for c in names]
    keyed = docs.select(*columns, F.xxhash64("text").alias(key))
    found = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key")), window)
    grouped = found.groupBy("doc_id", "row_key").agg(F.collect_list("first").alias(first_), F.collect_list("last").alias(last_)).withColumnsRenamed({"doc_id": doc, "row_key": own})
    joined = keyed.join(grouped, (F.col("doc_id") == F.col(doc)) & (F.col(key) == F.col(own)), "left").select(*columns, first_, last_)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(names.index("text")))
            whole, at = data.tobytes(), offsets.tolist()
            n_words, n_removed, kept = [], [], []
            for i, (first, last) in enumerate(zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True)):
                words = whole[at[i] : at[i + 1]].split()
                n = len(words)
                if first.is_valid:
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, first.values.to_numpy(), 1)
                    np.add.at(gone, last.values.to_numpy(), -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], [*names, "n_words", "n_removed", "kept"])

    schema = joined.select(*columns).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    # columns are passed by place, as a name may have a dot
    return joined.toDF(*(f"c{i}" for i in range(len(names) + 2))).mapInArrow(cut, schema)


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


