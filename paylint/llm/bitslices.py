"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers.  The index is a table of blocks of rows: for
each component and each bit of its value one bitmap over the block's rows, and the
rows' identifiers in rising order.  A query adds the slices of its components with
bitmap arithmetic (carry-save adders on 64-bit words): the result is the score of
every row of the block, sliced by bits.  The best k come from the most significant
slice downward, with bitmap operations and popcounts; rows at the boundary have
equal scores, and those with the smallest identifiers are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

#: Rows of a block; a block of queries has as many query vectors at most as QUERIES.
ROWS = 4096
QUERIES = 64
#: Blocks of rows that a task holds at once while queries stream by, at most.
HELD = 64


def quantised(embedding: Column, scale: float) -> Column:
    """floor(scale * x) for each component, or null where a component is null, NaN or infinite."""
    ok = embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(ok, F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")))


def _slices(values: np.ndarray, bits: int) -> np.ndarray:
    """(components, bits, words) bitmaps of (rows, components) values below 2**bits; rows are a multiple of 64."""
    by_component = np.ascontiguousarray(values.T)
    planes = [np.ascontiguousarray(np.packbits(((by_component >> b) & 1).astype(np.uint8), axis=1, bitorder="little")).view("<u8") for b in range(bits)]
    return np.stack(planes, axis=1)


def _add(total: list[np.ndarray], part: np.ndarray, weight: int) -> None:
    """Add a bitmap with the given power of two to the sliced sum, carrying upward."""
    while True:
        while len(total) <= weight:
            total.append(np.zeros_like(part))
        carry = total[weight] & part
        total[weight] = total[weight] ^ part
        if not carry.any():
            return
        part, weight = carry, weight + 1


def _sum(parts: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The sliced sum of bitmaps by weight: full adders take three bitmaps of a weight to one, and one of the next weight."""
    out, weight = [], 0
    while weight <= max(parts, default=-1):
        here, up = parts.pop(weight, []), parts.setdefault(weight + 1, [])
        while len(here) > 2:
            a, b, c = here.pop(), here.pop(), here.pop()
            ab = a ^ b
            here.append(ab ^ c)
            up.append((a & b) | (ab & c))
        if len(here) == 2:
            a, b = here
            here = [a ^ b]
            up.append(a & b)
        out.append(here[0] if here else None)
        if not up:
            parts.pop(weight + 1)
        weight += 1
    return out


def _top(score: list[np.ndarray], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query (row of the bitmaps) the rows surely among the best k, and the rows at the boundary."""
    sure, open_ = np.zeros_like(valid), valid.copy()
    for s in reversed(score):
        if s is None:
            continue
        tried = sure | (open_ & s)
        n = np.bitwise_count(tried).sum(axis=1)
        few = (n <= k)[:, None]
        sure = np.where(few, tried, sure)
        open_ = np.where(few, open_ & ~s, open_ & s)
    return sure, open_


def _first(bitmaps: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each row of bitmaps the first `most` of its bits, as an array of bits."""
    bits = np.unpackbits(bitmaps.view(np.uint8), axis=1, bitorder="little").astype(bool)
    return bits & (np.cumsum(bits, axis=1) <= most[:, None])


def _search(q: np.ndarray, slices: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the best k rows of a block for each query; equal scores go to the rows in front."""
    parts: dict[int, list[np.ndarray]] = {}
    size, bits = np.abs(q), slices.shape[1]
    for d in range(q.shape[1]):
        negative = (q[:, d] < 0)[:, None]
        for j in range(int(size[:, d].max()).bit_length()):
            has = np.where(((size[:, d] >> j) & 1).astype(bool)[:, None], np.uint64(2**64 - 1), np.uint64(0))
            for b in range(bits):
                # a negative component adds the complement: -v * s is s * (2**bits - 1 - v) but for a constant
                parts.setdefault(b + j, []).append(has & np.where(negative, ~slices[d, b], slices[d, b]))
        # keep few bitmaps open at a time
        if d % 8 == 7:
            parts = {w: [s] for w, s in enumerate(_sum(parts)) if s is not None}
    score = _sum(parts)
    sure, boundary = _top(score, valid, k)
    n = np.bitwise_count(sure).sum(axis=1).astype(np.int64)
    at, row = np.nonzero(np.unpackbits(np.ascontiguousarray(sure).view(np.uint8), axis=1, bitorder="little").astype(bool) | _first(np.ascontiguousarray(boundary), k - n))
    # the score of a row is read off its bits; values were raised by half their range, complements by the other half
    half = 1 << (bits - 1)
    total = -np.where(q > 0, q * half, -q * (half - 1)).sum(axis=1)[at]
    word, bit = row // 64, (row % 64).astype(np.uint64)
    for weight, s in enumerate(score):
        if s is not None:
            total += ((s[at, word] >> bit) & np.uint64(1)).astype(np.int64) << weight
    return at, row, total


def _vectors(good: DataFrame, scale: float) -> DataFrame:
    return good.withColumn("v", quantised(F.col("embedding"), scale)).where("v is not null and vec_id is not null").withColumn("dims", F.size("v")).drop("embedding")


def _packed(rows: DataFrame, size: int, bits: int | None) -> DataFrame:
    """(dims, block, n, ids, packed): rows (vec_id, v, dims) in blocks of `size` as they come, each in rising order of vec_id.

    packed holds bit slices of the given number of bits, or without it the values themselves.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        block = TaskContext.get().partitionId() << 32

        def out(dims: int) -> pa.RecordBatch:
            nonlocal block
            ids, v = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            if bits:
                raised = np.zeros((-(-len(ids) // 64) * 64, dims), np.int64)
                raised[: len(ids)] = v + (1 << (bits - 1))
                v = _slices(raised, bits)
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["dims", "block", "n", "ids", "packed"])

        for batch in batches:
            every = batch.column(2).to_numpy()
            for dims in np.unique(every).tolist():
                of = batch.filter(pa.array(every == dims)) if (every != dims).any() else batch
                ids, v = of.column(0).to_numpy(), of.column(1).flatten().to_numpy().reshape(-1, dims)
                while len(ids):
                    free = size - sum(len(i) for i, _ in held.get(dims, []))
                    held.setdefault(dims, []).append((ids[:free], v[:free]))
                    if len(ids) >= free:
                        yield out(dims)
                    ids, v = ids[free:], v[free:]
        for dims in list(held):
            yield out(dims)

    return rows.select("vec_id", "v", "dims").mapInArrow(pack, "dims int, block long, n long, ids binary, packed binary")


def index(vectors: DataFrame, scale: float = 256.0) -> tuple[DataFrame, int]:
    """The bit-sliced index of vectors (vec_id, embedding), a table (dims, block, n, ids, packed), and the bits of its values.

    Blocks are made where the rows are, without a shuffle; the table may be kept and
    searched again.
    """
    good = saved(_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), scale), "quantised")
    most = good.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    bits = int(most or 0).bit_length() + 1
    return saved(_packed(good, ROWS, bits), "slices"), bits


def _dealt(blocks: DataFrame, name: str, shares: int) -> DataFrame:
    """blocks with a share number, dealt in turn; one row of numbers for each block goes through a single task."""
    at = blocks.select("dims", "block").withColumn(name, F.pmod(F.row_number().over(Window.orderBy("dims", "block")), F.lit(shares)))
    return blocks.join(at, ["dims", "block"])


def search(indexed: DataFrame, bits: int, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of queries (vec_id, embedding), from an index.

    Blocks of rows are dealt into shares that fit into a task's memory, queries into
    as few as keep all cores busy.  Each share of rows meets each share of queries in
    one task: a sorted stream that brings the rows' slices first, which are held,
    and then the queries' blocks, one at a time.  A task passes on k rows for a
    query, and these are ranked with a limit before they are shuffled.
    """
    spark = indexed.sparkSession
    asked = _vectors(queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), scale).dropDuplicates(["vec_id", "v"])
    asked = saved(_packed(asked, QUERIES, None), "queries")
    n_blocks, n_asked, cores = indexed.count(), asked.count(), spark.sparkContext.defaultParallelism
    shares = max(1, -(-n_blocks // max(1, min(HELD, n_blocks // (4 * cores)))))
    parts = max(1, min(n_asked, -(-4 * cores // shares)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = _dealt(indexed, "share", shares).select("dims", "share", numbers(parts).alias("part"), F.lit(0).alias("kind"), "n", "ids", "packed")
    streamed = _dealt(asked, "part", parts).select("dims", numbers(shares).alias("share"), "part", F.lit(1).alias("kind"), "n", "ids", "packed")
    pairs = held.unionByName(streamed).repartition("share", "part", "dims").sortWithinPartitions("share", "part", "dims", "kind")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                of, kind, n = tuple(batch.column(i)[r].as_py() for i in (1, 2, 0)), batch.column(3)[r].as_py(), batch.column(4)[r].as_py()
                ids, packed, dims = np.frombuffer(batch.column(5)[r].as_buffer(), np.int64), batch.column(6)[r].as_buffer(), of[2]
                if of != key:
                    key, rows = of, []
                if kind == 0:
                    # copied, as the buffers of the batch go
                    rows.append((ids.copy(), np.frombuffer(packed, "<u8").reshape(dims, bits, -1).copy()))
                    continue
                q, best = np.frombuffer(packed, np.int64).reshape(n, dims), []
                for there, slices in rows:
                    valid = np.zeros((n, slices.shape[2] * 64), bool)
                    valid[:, : len(there)] = ids[:, None] != there
                    at, row, score = _search(q, slices, np.ascontiguousarray(np.packbits(valid, axis=1, bitorder="little")).view("<u8"), k)
                    best.append((at, there[row], score))
                if best:
                    at, found, score = (np.concatenate(x) for x in zip(*best, strict=True))
                    order = np.lexsort((found, -score, at))
                    at, found, score = at[order], found[order], score[order]
                    first = np.searchsorted(at, at)
                    kept = np.arange(len(at)) - first < k
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[kept]]), pa.array(found[kept]), pa.array(score[kept])], ["query_id", "vec_id", "score"])

    hits = pairs.mapInArrow(searched, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of vectors (vec_id, embedding) that meets the condition queries.

    Components count as floor(scale * x); the score is the integer inner product,
    which must fit in a long.  Candidates are all rows but those with the query's own
    vec_id; fewer than k candidates give fewer rows.  Equal scores go to the smaller
    vec_id.  Vectors that are null or empty or hold a null or non-finite component
    take no part, nor do rows without vec_id.  Vectors of different lengths are
    searched apart.  Repeated candidates count as often as they occur; a query that
    repeats is asked once, and the answers of rows with one vec_id and different
    vectors are ranked together.  Other columns are not looked at.
    """
    indexed, bits = index(vectors, scale)
    return search(indexed, bits, vectors.where(queries), k, scale)
