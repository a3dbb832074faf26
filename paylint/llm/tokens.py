"""Token ids as Parquet list columns: encoded once, written in document order, read back by column and range."""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import KEEP, LONG_WORD, Words, chunks, give_back, lists, utf8
from .storage import bounded_batches, new_path

#: Pieces of text kept with their ids in a worker, at most.
CACHE = 700_000
#: Pieces that stay in a worker between tasks, at most.
KEPT = 400_000
#: Texts are encoded in pieces of about so many bytes at a time.
CHUNK = 1 << 19
#: Pieces of more bytes are not kept.
LONG = LONG_WORD
#: New pieces encoded in one string.
JOINED = 128

#: Writer options of the format: row groups of 32 MB and pages of 256 KB (or 20,000 rows), each page in the page index.
LAYOUT = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "20000"}
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(2 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def _white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character of several bytes that ends before each place is white space, by any version of Unicode."""
    x, y, z = data[at - 3], data[at - 2], data[at - 1]
    two = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
    e1 = (x == 0xE1) & (((y == 0x9A) & (z == 0x80)) | ((y == 0xA0) & (z == 0x8E)))
    e2 = (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
    return two | e1 | e2 | ((x == 0xE3) & (y == 0x80) & (z == 0x80))


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of data, one after another."""
    return data[np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)]


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros behind the end."""
    return np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


class Encoder:
    """The ids of whole texts, from a byte-level BPE tokenizer file, by pieces.

    A text is cut before each space that follows something other than white
    space.  The pre-tokenizer always cuts there too and looks at nothing beyond, so
    the ids of the pieces, one after another, are the ids of the text.  Where it is
    the usual pattern, texts are also cut around a line feed without other white
    space beside it, and before marks that follow a letter or digit (ASCII or up to
    U+00FF), which the pattern does too.

    Each distinct piece is encoded once while it is in the cache.  Pieces are numbered,
    the end id is number 0.  ``table`` finds numbers by the hashes of pieces (open
    addressing), whose bytes are then compared.  ``start`` and ``size`` say where the
    ids of a numbered piece are in ``held``, ``first`` and ``length`` where its bytes are
    in ``bytes``, ``count`` how often it was asked for.
    """

    def __init__(self, path: str, end_id: int | None = 0):
        # a task has one core; threads of its own would only add memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        setup = json.loads(self.tokenizer.to_str())
        # characters of added tokens are left out, as these are found before any cut
        added = "".join(t["content"] for t in setup["added_tokens"])
        by = setup["pre_tokenizer"] or {}
        # bits: 1 a cut, 2 a cut if the line feed stands alone, 4 a cut before a mark, 8 a cut that depends on the character in front
        self.left, self.right = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
        self.left[0x21:0x80], self.left[0x80:] = 1, 8
        self.right[0x20] = 9
        if by.get("type") == "ByteLevel" and by.get("use_regex", True):
            if "\n" not in added:
                self.left[0x0A], self.right[0x0A] = 2, 9
                # white space of several bytes begins with one of four
                self.right[[b for b in range(0x21, 0x100) if b not in (0xC2, 0xE1, 0xE2, 0xE3)]] |= 2
            self.left[[ord(c) for c in string.ascii_letters + string.digits]] |= 4
            self.right[[ord(c) for c in string.punctuation if c not in added]] |= 12
        self.held = np.array([] if end_id is None else [end_id], np.int32)
        self.start, self.size, self.count = np.zeros(1, np.int64), np.array([len(self.held)]), np.zeros(1, np.int64)
        self.bytes, self.first, self.length, self.hash = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64)
        self.table = np.zeros(1 << 16, np.int32)

    @property
    def number(self) -> dict[str | None, int]:
        """The kept pieces with their numbers: what follows the space of a piece, or any other piece behind a space, and None for the end id."""
        pieces = [self.bytes[a : a + n].tobytes().decode() for a, n in zip(self.first[1:].tolist(), self.length[1:].tolist(), strict=True)]
        return {None: 0} | {p[1:] if p[:1] == " " else " " + p: i for i, p in enumerate(pieces, 1)}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts begin."""
        cut = np.zeros(len(data), bool)
        if not len(data):
            return np.zeros(0, np.int64)
        code = self.left[data[:-1]] & self.right[data[1:]]
        cut[1:] = (code & 5) != 0
        at = np.flatnonzero(code & 8) + 1
        mark = (self.right[data[at]] & 4) != 0
        letter = (data[at - 2] == 0xC3) & (data[at - 1] != 0x97) & (data[at - 1] != 0xB7)
        cut[at] = np.where(mark, letter, ~_white(data, at))
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(code & 2) + 1
        cut[at] |= cut[at - 1]
        return np.flatnonzero(cut)

    def _coded(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces, where those of each begin, and how many they are."""
        end = np.cumsum(size)
        first, last = data[end - size], data[end - 1]
        # pieces with a space in front and no other, that don't end in white space, are joined: the pattern parts them again
        joined = (first == 32) & (np.add.reduceat(data == 32, end - size, dtype=np.int64) == 1) & (last > 32)
        wide = np.flatnonzero(joined & (last >= 0x80))
        joined[wide] = ~_white(data, end[wide])
        at = np.flatnonzero(joined)
        text, to = _gather(data, (end - size)[at], size[at]).tobytes(), [0, *np.cumsum(size[at])[JOINED - 1 :: JOINED].tolist()]
        if len(at) % JOINED:
            to.append(len(text))
        coded = self._encode([text[a:z].decode() for a, z in zip(to, to[1:], strict=False)])
        ids = np.concatenate([*coded, np.zeros(0, np.int32)])
        # the ids that begin with a space tell the pieces apart, if there are as many, the first in front
        opens = np.flatnonzero(self.opens[ids])
        to = np.cumsum([0, *map(len, coded)])
        if len(opens) != len(at) or not np.array_equal(opens[::JOINED], to[:-1]):
            joined, at, ids, opens = np.zeros(len(size), bool), at[:0], ids[:0], opens[:0]
        rest, text = np.flatnonzero(~joined), data.tobytes()
        alone = self._encode([text[a:z].decode() for a, z in zip((end - size)[rest].tolist(), end[rest].tolist(), strict=True)])
        n = np.zeros(len(size), np.int64)
        n[at], n[rest] = np.diff(opens, append=len(ids)), [len(x) for x in alone]
        order, begin = np.concatenate([at, rest]), np.zeros(len(size), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate([ids, *alone]), begin, n

    def _found(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece of each hash, 0 if none is known."""
        mask, shift = len(self.table) - 1, np.uint64(65 - len(self.table).bit_length())
        slot = (h >> shift).astype(np.int64)
        at = self.table[slot]
        rows = np.flatnonzero((at != 0) & (self.hash[at] != h))
        while len(rows):
            slot[rows] = (slot[rows] + 1) & mask
            at[rows] = self.table[slot[rows]]
            rows = rows[(at[rows] != 0) & (self.hash[at[rows]] != h[rows])]
        return at

    def _enter(self, known: int) -> None:
        """Enter the pieces from number known on into the table."""
        if 2 * len(self.hash) > len(self.table):
            self.table, known = np.zeros(1 << (4 * len(self.hash)).bit_length(), np.int32), 1
        mask, shift = len(self.table) - 1, np.uint64(65 - len(self.table).bit_length())
        n = np.arange(known, len(self.hash), dtype=np.int32)
        slot = (self.hash[n] >> shift).astype(np.int64)
        while len(n):
            free = self.table[slot] == 0
            self.table[slot[free]] = n[free]
            left = self.table[slot] != n
            slot, n = (slot[left] + 1) & mask, n[left]

    def _learn(self, data: np.ndarray, size: np.ndarray, h: np.ndarray) -> None:
        known = len(self.hash)
        ids, begin, n = self._coded(data, size)
        self.start, self.size = np.append(self.start, len(self.held) + begin), np.append(self.size, n)
        self.first, self.length = np.append(self.first, len(self.bytes) + np.cumsum(size) - size), np.append(self.length, size)
        self.held, self.bytes, self.hash = np.append(self.held, ids), np.append(self.bytes, data), np.append(self.hash, h)
        self.count = np.append(self.count, np.zeros(len(n), np.int64))
        self._enter(known)

    def _differ(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether pieces differ from the numbered ones."""
        out = self.length[at] != size
        here, there, first = _lanes(data), _lanes(self.bytes), self.first[at]
        rows, k = np.flatnonzero(~out), 0
        while len(rows):
            out[rows] = ((here[start[rows] + k] ^ there[first[rows] + k]) & KEEP[np.minimum(size[rows] - k, 8)]) != 0
            k += 8
            rows = rows[~out[rows] & (size[rows] > k)]
        return out

    def rest(self, keep: int = KEPT) -> None:
        """Give memory back: keep the most frequent pieces.

        Done at the end of a task too, as workers live on and other stages share their executors.
        """
        if len(self.size) <= keep:
            return
        rank = -1 - self.count
        # the end id stays number 0
        rank[0] = rank.min() - 1
        kept = np.sort(np.argsort(rank, kind="stable")[:keep])
        self.held, self.bytes = self._ids(kept), _gather(self.bytes, self.first[kept], self.length[kept])
        self.size, self.length, self.count, self.hash = self.size[kept], self.length[kept], self.count[kept], self.hash[kept]
        self.start, self.first = np.cumsum(self.size) - self.size, np.cumsum(self.length) - self.length
        self.table[:] = 0
        self._enter(1)

    def _ids(self, at: np.ndarray) -> np.ndarray:
        """The ids of the numbered pieces, one after another."""
        return _gather(self.held, self.start[at], self.size[at])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, the end id counted, and the ids of all texts one after another."""
        return self.ids(*utf8(pa.array(texts, pa.large_string())))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As a call, of texts given by their bytes and where each begins, and the end."""
        if len(self.size) > CACHE:
            self.rest()
        if len(offsets) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        start = self._cut(data, offsets)
        if len(offsets) == 2 and len(data) > 2 * CHUNK:
            # a long text goes by stretches that begin with a piece
            at = np.searchsorted(start, np.arange(0, len(data), CHUNK))
            to = [*np.unique(start[at[at < len(start)]]).tolist(), len(data)]
            if len(to) > 2:
                parts = [self.ids(data[a:z], np.array([0, z - a]))[1] for a, z in zip(to, to[1:], strict=False)]
                end = int(self.size[0])
                values = np.concatenate([*(x[: len(x) - end] for x in parts[:-1]), parts[-1]])
                return np.array([len(values)]), values
        size = np.diff(start, append=len(data))
        at, short = np.zeros(len(start), np.int64), np.flatnonzero(size <= LONG)
        begin, length = start[short], size[short]
        h = Words(data, begin, begin + length, offsets, offsets).hashes()
        found = self._found(h)
        new = np.flatnonzero(found == 0)
        if len(new):
            known = len(self.hash)
            each, one, which = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one]
            self._learn(_gather(data, begin[one], length[one]), length[one], each)
            found[new] = known + which
        at[short] = found
        # pieces that are not kept: long ones, and those with another's hash
        at[short[self._differ(data, begin, length, found)]] = 0
        apart = np.flatnonzero(at == 0)
        here, known = self, len(self.size)
        self.count += np.bincount(at[at > 0], minlength=known)
        self.count[0] += len(offsets) - 1
        if len(apart):
            numbers: dict[bytes, int] = {}
            at[apart] = [numbers.setdefault(data[a : a + n].tobytes(), known + len(numbers)) for a, n in zip(start[apart].tolist(), size[apart].tolist(), strict=True)]
            ids, begin, n = self._coded(np.frombuffer(b"".join(numbers), np.uint8), np.array([len(p) for p in numbers]))
            here = copy(self)
            here.start, here.size, here.held = np.append(self.start, len(self.held) + begin), np.append(self.size, n), np.append(self.held, ids)
        # an end id goes behind the pieces of each text
        first = np.searchsorted(start, offsets)
        texts = np.arange(len(offsets) - 1)
        pieces = np.zeros(len(at) + len(texts), np.int64)
        pieces[np.arange(len(at)) + np.repeat(texts, np.diff(first))] = at
        return np.add.reduceat(here.size[pieces], first[:-1] + texts), here._ids(pieces)


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, end_id: int | None) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 0, encoding: str = "dictionary") -> None:
    """Write the ids of every text of docs (doc_id, text) to the Parquet folder out.

    Columns: doc_id, n_tokens, part, before (ids of earlier documents of the same
    part) and ids, a list of 32-bit integers.  Parts hold rising ranges of doc_id
    (nulls first) and are sorted inside; rows with equal doc_id are next to each
    other, ordered by the hash of the text.  Texts are shuffled once, by range.
    Null texts are empty: they hold the end id alone.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_h"))
    ordered = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for rows, data, offsets in chunks(batches, "text", CHUNK):
            n, values = encoder.ids(data, offsets)
            ends, ids = np.cumsum(n), lists(values, n)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends - n), ids], ["doc_id", "n_tokens", "part", "before", "ids"])
            before += int(ends[-1]) if len(ends) else 0
        encoder.rest()
        give_back()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, part int, before long, ids array<int>"
    ordered.select("doc_id", "text").mapInArrow(encode, schema).write.options(**LAYOUT, **ENCODINGS[encoding]).parquet(out)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of a written folder; the ids are not read.

    start counts the ids of all documents before.  One row for each part goes
    through a single task to sum the parts up; the sums are broadcast, a row a part.
    """
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", "part", "before")
    return _started(spark, path, rows).select("doc_id", "start", "n_tokens")


def tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of those with first <= doc_id <= last.

    Parts, row groups and pages outside the range are skipped by their statistics.
    """
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return _started(spark, path, rows).select("doc_id", "start", "n_tokens", "ids")


def _started(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    offsets = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_offset"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("_offset") + F.col("before"))


def digests(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what tokens() read."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:z].tobytes()) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = read.schema["doc_id"].dataType.simpleString()
    return read.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None = 0, encoding: str = "dictionary") -> DataFrame:
    """Write docs to a new folder in the shared folder and give the digests of what is read back."""
    spark = docs.sparkSession
    out = new_path(spark, "tokens")
    write(docs, out, tokenizer, end_id, encoding)
    return digests(tokens(spark, out))
