"""Alignment of two tokenizers: which tokens of A and B lie on the same bytes, document by document and over the corpus.

Both tokenizers always cut before a space that follows something other than white
space, so a text is aligned by such pieces, and each distinct piece once while a
worker holds it.  Most groups are one token of either side with the same bytes: an
array from A's ids to B's says so, and their links are counted in vectors of A's
vocabulary.  Only links of other groups enter the shuffle of id pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, give_back, lists
from .storage import bounded_batches, saved

#: Pieces that a worker holds with their alignment, at most.
CACHE = 200_000
#: Pieces that stay in a worker between tasks, at most.
KEPT = 30_000
#: New pieces encoded in one string.
JOINED = 128
#: Texts are aligned about so many bytes at a time; longer ones in sections.
CHUNK = 1 << 20
#: Tables of irregular id pairs of at most this many rows are broadcast, longer ones are shuffled.
BROADCAST_PAIRS = 1_000_000
#: Before a space that follows something other than white space both tokenizers always begin a new token.
_CUT = re.compile(r"(?<=\S)(?= )")
_SPACE = "▁"


class ByteLevel:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # printable bytes stand for themselves, the others, in rising order, for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        held = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocab = self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if token not in special:
                self.bytes[i] = bytes(held[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of a space and each text."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A model file of the sentencepiece library, which puts a space in front of a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        names = self.model.id_to_piece(list(range(n)))
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in names):
            raise ValueError("a piece of this model reaches over the beginning of a word")
        self.bytes = [b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)]
        self.byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.space = self.model.piece_to_id(_SPACE)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of a space and each text. The library gives the empty text none, not even its space."""
        return [ids or [self.space] for ids in self.model.encode(texts, num_threads=1)]


def identity_map(a: list[bytes], b: list[bytes], single: np.ndarray) -> np.ndarray:
    """For each id of A the id of B with the same bytes, or -1. single: B's ids for bytes of characters it has no piece for; they are no such ids."""
    of = {x: i for i, x in enumerate(b) if x and not single[i]}
    return np.array([of.get(x, -1) if x else -1 for x in a], np.int32)


def _ragged(start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indices of the runs `at`, one after another."""
    n = size[at]
    return np.arange(n.sum()) + np.repeat(start[at] - np.cumsum(n) + n, n)


class Aligner:
    """The alignment of texts, by pieces; each distinct piece has a number while it is held.

    For piece i: ``counts[i]`` are its tokens of A and B, groups and links,
    ``text[i]`` its groups, ``bad[i]`` says that bytes differ, and runs of
    ``regular`` and ``pairs`` hold A's ids of its regular links and its other links as a * |B| + b.
    """

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.length_a, self.length_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.same = identity_map(self.a.bytes, self.b.bytes, self.b.byte)
        self.names = [str(i) for i in range(max(len(self.length_a), len(self.length_b)))]
        self.empty()

    def empty(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.counts, self.bad = np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.regular, self.regular_start, self.regular_size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.pairs_start, self.pairs_size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rest(self, keep: int = KEPT) -> None:
        """Keep the pieces numbered first, which tend to be the most frequent, and give back the memory of others."""
        n = min(keep, len(self.text))
        self.number = dict(list(self.number.items())[:n])
        self.text, self.counts, self.bad = self.text[:n], self.counts[:n].copy(), self.bad[:n].copy()
        for name in ("regular", "pairs"):
            start, size, held = getattr(self, f"{name}_start")[:n].copy(), getattr(self, f"{name}_size")[:n].copy(), getattr(self, name)
            setattr(self, name, held[: int(size.sum())].copy())
            setattr(self, f"{name}_start", start)
            setattr(self, f"{name}_size", size)

    def _learn(self, new: list[str]) -> None:
        """Align the pieces (what follows their first space) and number them."""
        joinable = [p for p in new if p and not p[-1].isspace() and _SPACE not in p]
        alone = [p for p in new if not p or p[-1].isspace() or _SPACE in p]
        order = [*joinable, *alone]
        texts = [" ".join(joinable[i : i + JOINED]) for i in range(0, len(joinable), JOINED)] + alone
        size = np.array([1 + len(p.encode()) for p in order], np.int64)
        bad = np.zeros(len(order), bool)
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        for i, p in enumerate(alone, len(joinable)):
            k = i - len(joinable) + len(texts) - len(alone)
            if b"".join(self.a.bytes[x] for x in ids_a[k]) != b"".join(self.b.bytes[x] for x in ids_b[k]) or _SPACE in p:
                bad[i], ids_a[k], ids_b[k], size[i] = True, [], [], 0
        a, b = (np.fromiter((x for ids in group for x in ids), np.int64) for group in (ids_a, ids_b))
        end_a, end_b, end = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), np.cumsum(size)
        # joined strings have the bytes of their pieces on both sides, or one of the tokenizers doesn't do what it must
        if (len(end_a) and end_a[-1] != end[-1]) or (len(end_b) and end_b[-1] != end[-1]):
            raise ValueError("tokens don't have the bytes of their text")
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        if not np.isin(end[size > 0], shared).all():
            raise ValueError("a token reaches over the beginning of a piece")
        upto_a, upto_b, upto = (np.searchsorted(x, end, "right") for x in (end_a, end_b, shared))
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        first_a, first_b = np.searchsorted(group_a, np.arange(len(shared) + 1)), np.searchsorted(group_b, np.arange(len(shared) + 1))
        # a token of B overlaps those of A from the one that holds its first byte to the one that holds its last
        start_b = end_b - self.length_b[b]
        from_a, to_a = np.searchsorted(end_a, start_b, "right"), np.searchsorted(end_a, end_b, "left")
        links = to_a - from_a + 1
        regular = (np.diff(first_a) == 1) & (np.diff(first_b) == 1)
        regular[regular] = self.same[a[first_a[:-1][regular]]] == b[first_b[:-1][regular]]
        held = a[first_a[:-1][regular]].astype(np.int32)
        other = ~regular[group_b]
        left = _ragged(from_a, links, np.flatnonzero(other))
        pairs = a[left] * len(self.length_b) + np.repeat(b[other], links[other])
        piece_of_group, piece_of_b = np.searchsorted(upto, np.arange(len(shared)), "right"), np.searchsorted(upto_b, np.arange(len(b)), "right")
        n = len(order)
        n_regular = np.bincount(piece_of_group[regular], minlength=n)
        n_pairs = np.bincount(piece_of_b[other], links[other], n).astype(np.int64)
        counts = np.stack([np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0), np.diff(upto, prepend=0), n_regular + n_pairs], axis=1)
        names, la, lb, fa, fb, known = self.names, a.tolist(), b.tolist(), first_a.tolist(), first_b.tolist(), len(self.text)
        groups = [f"{names[la[i]]}|{names[lb[k]]}" if z - i == 1 and y - k == 1 else ",".join([names[x] for x in la[i:z]]) + "|" + ",".join([names[x] for x in lb[k:y]]) for i, z, k, y in zip(fa[:-1], fa[1:], fb[:-1], fb[1:], strict=True)]
        ends = [0, *upto.tolist()]
        self.text += [groups[x] if z - x == 1 else ";".join(groups[x:z]) for x, z in zip(ends[:-1], ends[1:], strict=True)]
        self.number.update(zip(order, range(known, known + n), strict=True))
        self.counts, self.bad = np.concatenate([self.counts, counts]), np.append(self.bad, bad)
        for name, values, sizes in (("regular", held, n_regular), ("pairs", pairs, n_pairs)):
            old = getattr(self, name)
            setattr(self, f"{name}_start", np.append(getattr(self, f"{name}_start"), len(old) + np.cumsum(sizes) - sizes))
            setattr(self, f"{name}_size", np.append(getattr(self, f"{name}_size"), sizes))
            setattr(self, name, np.concatenate([old, values]))

    def _keys(self, text: str) -> list[str]:
        """What follows the first space of each piece of a space and the text."""
        keys = text.split(" ")
        if not all(keys) or any(p[-1].isspace() for p in keys):
            return [p[1:] for p in _CUT.split(" " + text)]
        return keys

    def _sections(self, text: str) -> Iterator[str]:
        """The text in sections of about CHUNK characters; what follows a section's cut is a space, which the next section leaves out."""
        while len(text) > CHUNK:
            cut = _CUT.search(text, CHUNK)
            if not cut:
                break
            yield text[: cut.start()]
            text = text[cut.start() + 1 :]
        yield text

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Of each text: tokens of A and B, groups, links; the hash of its groups; its regular and its other links, with how often, as (text, value, n).

        A text without tokens has zeros, an empty hash and no links.
        """
        counts, sums = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        found: dict[str, list[tuple[np.ndarray, ...]]] = {"regular": [], "pairs": []}
        batch: list[tuple[int, list[str]]] = []
        held = 0
        open_: dict[int, hashlib._Hash | None] = {}

        def settle() -> None:
            nonlocal batch, held
            keys = [k for _, part in batch for k in part]
            new = [k for k in dict.fromkeys(keys) if k not in self.number]
            if len(self.text) + len(new) > CACHE:
                self.rest(CACHE // 2)
                new = [k for k in dict.fromkeys(keys) if k not in self.number]
            if new:
                self._learn(new)
            at = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
            sizes = np.array([len(part) for _, part in batch], np.int64)
            first = np.cumsum(sizes) - sizes
            of = np.array([i for i, _ in batch], np.int64)
            spoiled = np.logical_or.reduceat(self.bad[at], first)
            np.add.at(counts, of, np.add.reduceat(self.counts[at], first))
            listed = at.tolist()
            for i, a, n, wrong in zip(of.tolist(), first.tolist(), sizes.tolist(), spoiled.tolist(), strict=True):
                if wrong or (i in open_ and open_[i] is None):
                    open_[i] = None
                    continue
                part = ";".join(map(self.text.__getitem__, listed[a : a + n])).encode()
                if i in open_:
                    open_[i].update(b";" + part)
                else:
                    open_[i] = hashlib.sha256(part)
            text_of = np.repeat(of, sizes)
            for name, width in (("regular", len(self.length_a)), ("pairs", len(self.length_a) * len(self.length_b))):
                size = getattr(self, f"{name}_size")
                values = getattr(self, name)[_ragged(getattr(self, f"{name}_start"), size, at)].astype(np.int64)
                keyed, n = np.unique(np.repeat(text_of, size[at]) * width + values, return_counts=True)
                found[name].append((keyed // width, keyed % width, n))
            batch, held = [], 0

        for i, text in enumerate(texts):
            if text:
                for section in self._sections(text):
                    batch.append((i, self._keys(section)))
                    held += len(section)
                    if held >= CHUNK:
                        settle()
        if batch:
            settle()
        good = np.zeros(len(texts), bool)
        for i, h in open_.items():
            if h is not None:
                sums[i], good[i] = h.hexdigest(), True
        counts[~good] = 0
        out = []
        for name in ("regular", "pairs"):
            text, value, n = (np.concatenate([p[k] for p in found[name]]) if found[name] else np.zeros(0, np.int64) for k in range(3))
            keep = good[text] if len(text) else np.zeros(0, bool)
            out.append((text[keep], value[keep], n[keep]))
        return counts, sums, *out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, ids, ids_n, pairs, pairs_n) of docs (doc_id, text).

    row tells rows apart.  ids and ids_n have A's ids of the document's regular
    links and how often each occurs, pairs and pairs_n its other links as a * |B| + b;
    an entry that several sections of a long text hold is listed for each.
    """
    bounded_batches(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(a, b), TaskContext.get().partitionId() << 40
        for rows, _, _ in chunks(batches, "text", CHUNK):
            counts, sums, *links = aligner(rows.column(1).to_pylist())
            n = len(sums)
            columns = [pa.array(np.arange(row, row + n)), rows.column(0), *(pa.array(np.ascontiguousarray(c)) for c in counts.T), pa.array(sums)]
            for (text, value, times), kind in zip(links, (np.int32, np.int64), strict=True):
                order = np.argsort(text, kind="stable")
                size = np.bincount(text, minlength=n)
                columns += [lists(value[order].astype(kind), size), lists(times[order].astype(np.int32), size)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids", "ids_n", "pairs", "pairs_n"])
            row += n
        aligner.rest()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids array<int>, ids_n array<int>, pairs array<long>, pairs_n array<int>"
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(align, schema)


def _vectors(rows: DataFrame, size: int) -> DataFrame:
    """(id, n): how often each id of A has a regular link; each task adds up one vector of the vocabulary's length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), size).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["id", "n"])

    return rows.select("ids", "ids_n").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _others(rows: DataFrame) -> DataFrame:
    """(row, pair, n): irregular links."""
    zipped = F.explode(F.arrays_zip("pairs", "pairs_n")).alias("link")
    return rows.select("row", zipped).select("row", F.col("link.pairs").alias("pair"), F.col("link.pairs_n").cast("long").alias("n"))


def pair_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(pair, n, best, id) of all id pairs over the corpus, pair as a * |B| + b.

    best says that no pair of its B id has a higher count; id is A's id if the pair
    is its regular one, else null.
    """
    here = Aligner(a, b)
    width = len(here.length_b)
    known = [(int(i), int(i) * width + int(here.same[i])) for i in np.flatnonzero(here.same >= 0)]
    # an entry for each id of A, at most
    mapped = F.broadcast(rows.sparkSession.createDataFrame(known, "id long, pair long"))
    regular = _vectors(rows, len(here.same)).join(mapped, "id").select("pair", "n")
    other = _others(rows).groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = saved(regular.unionByName(other).groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.pmod("pair", F.lit(width))
    # a row for each id of B, at most
    most = F.broadcast(pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("most")))
    best = pairs.join(most, b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return saved(best.join(mapped, "pair", "left"), "best-pairs")


def summed(rows: DataFrame, pairs: DataFrame, size: int, broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of rows from aligned() and pairs from pair_counts(); size: ids of A.

    Counts of regular links come to each task as vectors of A's vocabulary, those of
    other links in a join by pair: broadcast if there are `broadcast` pairs at most, else
    shuffled, where a hot pair is split by adaptive execution.  Their sums per row
    combine before the shuffle.
    """
    got = pairs.where("id is not null").select("id", "n", F.col("best").cast("long").alias("best")).toArrow()
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = got.column("id").to_numpy()
    count[at], best[at] = got.column("n").to_numpy(), got.column("best").to_numpy()
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, times = batch.column(len(names)), batch.column(len(names) + 1).flatten().to_numpy().astype(np.int64)
            value = ids.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
            columns = [pa.array(np.diff(np.concatenate([[0], np.cumsum(each[value] * times)])[ends])) for each in (best, count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], [*names, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", n_best long, count_sum long"
    mine = rows.select(*names, "ids", "ids_n").mapInArrow(add, schema)
    known = F.broadcast(pairs) if pairs.count() <= broadcast else pairs
    links = _others(rows).join(known.select("pair", "best", F.col("n").alias("count")), "pair")
    others = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("count")).alias("_sum"))
    zero = F.lit(0).cast("long")
    return mine.join(others, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", zero)).alias("count_sum"), "groups_sha256")


def compared(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each row of docs (doc_id, text): its alignment by tokenizers a and b, and how its links fare in the corpus.

    a: a byte-level BPE file, b: a sentencepiece model; both read a space and the
    text.  Byte offsets where tokens of both end cut a text into groups.  A link is
    an occurrence of an A and a B token whose bytes overlap; the count of an id pair
    is the links of the corpus that hold it.  n_best are links whose count is the
    highest of their B id, count_sum is the sum of counts over links,
    groups_sha256 the hash of the groups' ids.

    Null and empty texts, and texts whose tokens of either side don't have the
    bytes of a space and the text (those with U+2581), have zeros and an empty hash, and add
    to no count.  Repeated rows each count.  Long texts are aligned in sections.  An
    empty table gives no rows; other columns don't matter; doc_id may be null.
    """
    rows = saved(aligned(docs, a, b), "aligned")
    return summed(rows, pair_counts(rows, a, b), len(ByteLevel(a).bytes))
