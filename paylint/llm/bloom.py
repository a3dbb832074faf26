"""A blocked Bloom filter as a DataFrame: one row of four 64-bit words for each block.

All five bits of a key lie in one 256-bit block, so a probe is one lookup.  Keys
are 64-bit hashes; the block comes from the low 24 bits and the bits from the
top 40.  A filter of up to ``MAX_BLOCKS`` (32 bytes each) is broadcast; a larger one,
of up to ``MOST_BLOCKS``, is joined by block with a shuffle.  A list too long for
its filter only lets more keys through, and whoever uses the filter joins exactly
afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free

WORDS = 4
PROBES = 5
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 18
MOST_BLOCKS = 1 << 24


def blocks_for(keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    n = 1
    while n * 256 < keys * BITS_PER_KEY and n < max_blocks:
        n *= 2
    return n


def _block(h: Column, blocks: int) -> Column:
    return h.bitwiseAND(F.lit(blocks - 1).cast("long"))


def _masks(h: Column) -> list[Column]:
    at = [F.shiftrightunsigned(h, 24 + 8 * i).bitwiseAND(F.lit(255).cast("long")) for i in range(PROBES)]
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for p in at:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63).cast("long")).cast("int"))
            mask = mask.bitwiseOR(F.when(F.shiftright(p, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return masks


def build(keys: DataFrame, h: Column, blocks: int) -> DataFrame:
    """(block, w0..w3) from the hashes of the keys; nulls are left out."""
    masked = keys.select(h.alias("h")).where("h is not null").select(_block(F.col("h"), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("h")))))
    return masked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def possible(df: DataFrame, h: Column, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows of df whose key may be in the filter; null keys are in none."""
    key, block, *words = free(df, "_hash", "_block", *(f"_w{i}" for i in range(WORDS)))
    held = filter_.withColumnsRenamed({"block": block} | {f"w{i}": w for i, w in enumerate(words)})
    held = F.broadcast(held) if blocks <= MAX_BLOCKS else held
    probe = df.withColumn(key, h).where(F.col(key).isNotNull()).withColumn(block, _block(F.col(key), blocks)).join(held, block)
    for w, m in zip(words, _masks(F.col(key)), strict=True):
        probe = probe.where(F.col(w).bitwiseAND(m) == m)
    return probe.select(*(F.col(f"`{c}`") for c in df.columns))


def collected(filter_: DataFrame, blocks: int) -> np.ndarray:
    """The filter as an array of (blocks, 4) uint64, at most 32 * MAX_BLOCKS bytes."""
    out = np.zeros((blocks, WORDS), np.uint64)
    rows = filter_.toArrow()
    at = rows.column("block").to_numpy()
    for i in range(WORDS):
        out[at, i] = rows.column(f"w{i}").to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash, whether the collected filter may hold it."""
    block = (h & np.uint64(len(words) - 1)).astype(np.int64)
    found = np.ones(len(h), bool)
    for i in range(PROBES):
        p = (h >> np.uint64(24 + 8 * i)) & np.uint64(255)
        found &= (words[block, (p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0
    return found
