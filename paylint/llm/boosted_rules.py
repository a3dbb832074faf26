"""Quality rules: fixed limits on document statistics, and boosted trees over statistics for what passes them.

Trees are grown from binned features with Newton steps on the logistic loss.  A
feature with a sign may only raise (+1) or lower (-1) the score: splits against the
sign are refused, and the children's scores are held on their side of the middle.
All trees lie in one set of numpy arrays of nodes, in which a leaf leads to itself,
so texts are scored by a few array look-ups for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality
from .arrays import mix, ngrams, split, utf8
from .storage import bounded_batches, free, saved

#: Labelled documents the trees are fitted on, at most: those with the smallest hash of doc_id; half of them weigh words, half grow trees.
LABELLED = 20_000
#: Texts are measured in pieces of about so many bytes, or one text.
PIECE = 2 << 20
#: Fixed limits: the least number of words, and the largest share of words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
KEEP = 0.5

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("chars_per_word", "symbols_per_word", "dup_lines_per_word", "repeated_share")
FEATURES = (*quality.FEATURES, *RATES)
#: More of these never makes a text better, and more different words never make it worse.
SIGNS = {"bad_words": -1, "word_odds": -1, "repeated": -1, "commonest": -1, "symbols_per_word": -1, "dup_lines_per_word": -1, "repeated_share": -1, "distinct": 1}

_SYMBOL, _START, _BLANK = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(SYMBOLS)] = True
_START[:] = (np.arange(256) & 0xC0) != 0x80
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _count(where: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(where, dtype=np.int64)])[at])


def _repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    w = split(data, offsets)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)), np.int64)
    out[:, 0] = w.n
    out[:, 1] = _count(_START[data] & ~_BLANK[data], offsets)
    out[:, 2] = _count(_SYMBOL[data], offsets)
    text = data.tobytes()
    out[:, 3] = [_repeated_lines(text[a:z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    if len(w.start):
        whole = w.windows(3)
        at = np.flatnonzero(whole)
        grams = mix(ngrams(w.hashes(), 3)[whole], np.repeat(np.arange(len(w.n), dtype=np.uint64), w.n)[whole])
        order = np.argsort(grams)
        same = grams[order[1:]] == grams[order[:-1]]
        found = at[np.concatenate([order[1:][same], order[:-1][same]])]
        covered = np.zeros(len(w.start), bool)
        for k in range(3):
            covered[found + k] = True
        out[:, 4] = _count(covered, w.of)
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, STATISTICS), exact but for windows of three words, which are compared by 64-bit hashes; nulls are empty texts."""
    data, offsets = utf8(texts)
    out, row = [np.zeros((0, len(STATISTICS)), np.int64)], 0
    while row < len(texts):
        to = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1))
        out.append(_statistics(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]))
        row = to
    return np.concatenate(out)


def features(texts: pa.Array, counts: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """(texts, FEATURES); rates of short texts are damped."""
    n = counts[:, 0] + 10.0
    rates = np.stack([counts[:, 1] / n, counts[:, 2] / n, counts[:, 3] / n, counts[:, 4] / n], axis=1)
    return np.concatenate([quality.features(texts, odds), rates], axis=1)


def failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


@dataclass
class Trees:
    """Nodes of all trees, one after another. A leaf has the threshold infinity and leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row of x."""
        out = np.full(len(x), self.base)
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            row = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[a : a + 4096] += self.value[node].sum(1)
        return out


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 4.0) -> Trees:
    """Boosted trees for y in {0, 1}; without rows of both kinds, none and the score 0.

    signs: -1, 0 or +1 for each feature.  ridge damps the scores of leaves, `least` is
    the curvature (about a quarter of the rows) that a leaf must have.
    """
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    both = len(np.unique(y)) == 2
    base = float(np.log(y.mean() / (1 - y.mean()))) if both else 0.0

    def add(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    if both:
        edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            slope, bend = y - p, p * (1 - p)
            roots.append(add(0.0))
            open_ = [(roots[-1], np.arange(len(y)), -np.inf, np.inf)]
            for _ in range(depth):
                following = []
                for at, rows, low, high in open_:
                    found = _best(binned[rows], slope[rows], bend[rows], edges, signs, low, high, ridge, least, bins)
                    if found is None:
                        continue
                    f, b, left, right = found
                    goes = binned[rows, f] <= b
                    middle = (left + right) / 2
                    a, z = add(rate * left), add(rate * right)
                    nodes["feature"][at], nodes["threshold"][at], nodes["left"][at], nodes["right"][at] = f, edges[f][b], a, z
                    low_left, high_left, low_right, high_right = low, high, low, high
                    if signs[f] > 0:
                        high_left = low_right = middle
                    elif signs[f] < 0:
                        low_left = high_right = middle
                    following += [(a, rows[goes], low_left, high_left), (z, rows[~goes], low_right, high_right)]
                    raw[rows] += rate * np.where(goes, left, right) - nodes["value"][at]
                open_ = following
    kinds = {"feature": np.int64, "threshold": float, "left": np.int64, "right": np.int64, "value": float}
    return Trees(*(np.array(nodes[k], t) for k, t in kinds.items()), np.array(roots, np.int64), depth, base)


def _best(binned: np.ndarray, slope: np.ndarray, bend: np.ndarray, edges: list[np.ndarray], signs: np.ndarray, low: float, high: float, ridge: float, least: float, bins: int) -> tuple[int, int, float, float] | None:
    """The feature, its bin, and the scores left and right of the split that lowers the loss most, if any does."""
    g, h = slope.sum(), bend.sum()

    def gain(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.clip(g / (h + ridge), low, high)
        return g * score - (h + ridge) * score * score / 2, score

    best, most = None, float(gain(g, h)[0]) + 1e-3
    for f, e in enumerate(edges):
        if not len(e):
            continue
        gl = np.cumsum(np.bincount(binned[:, f], slope, bins))[: len(e)]
        hl = np.cumsum(np.bincount(binned[:, f], bend, bins))[: len(e)]
        (gain_left, left), (gain_right, right) = gain(gl, hl), gain(g - gl, h - hl)
        fits = (hl >= least) & (h - hl >= least) & (signs[f] * (right - left) >= 0)
        total = np.where(fits, gain_left + gain_right, -np.inf)
        b = int(total.argmax())
        if total[b] > most:
            best, most = (f, b, float(left[b]), float(right[b])), float(total[b])
    return best


@dataclass
class Rules:
    trees: Trees
    odds: np.ndarray
    threshold: float = KEEP

    def __call__(self, texts: pa.Array) -> pa.Array:
        counts = statistics(texts)
        below = failed(counts)
        score = 1 / (1 + np.exp(-self.trees.score(features(texts, counts, self.odds))))
        columns = [*counts.T, below, score, ~below & (score >= self.threshold)]
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ADDED)


#: The columns that judged() adds.
ADDED = [*STATISTICS, "base_failed", "probability", "kept"]
_KIND = "struct<" + ", ".join([*(f"{c}: long" for c in STATISTICS), "base_failed: boolean", "probability: double", "kept: boolean"]) + ">"


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, threshold: float = KEEP, signs: dict[str, int] = SIGNS) -> Rules:
    """Trees from documents and labels (doc_id, quality, toxic): good means quality 1 and not toxic.

    At most `labelled` labels, a documented bound, are broadcast to the scan of docs;
    half of their documents give each word's odds, the other half the rows of
    features that the driver grows the trees from.  Without both kinds no trees.
    """
    bounded_batches(docs.sparkSession)
    good = quality.chosen(labels, labelled).withColumnRenamed("doc_id", "_doc")
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc"), "text").join(F.broadcast(good), F.col("doc") == F.col("_doc")).groupBy("doc", "good").agg(F.min("text").alias("text"))
    rows = saved(rows.withColumn("half", F.pmod(F.xxhash64(F.lit("rules"), "doc"), F.lit(2))), "labelled")
    odds = quality._odds(rows.where("half = 0"))

    def measured(batches):
        for b in batches:
            x = features(b.column(0), statistics(b.column(0)), odds)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel())), b.column(1), b.column(2)], ["x", "y", "doc"])

    got = rows.where("half = 1").select("text", "good", "doc").mapInArrow(measured, "x array<double>, y int, doc long").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    # in the order of doc_id, the trees don't depend on which task ends first
    at = np.argsort(got.column("doc").to_numpy(), kind="stable")
    sign = np.array([signs.get(f, 0) for f in FEATURES])
    return Rules(grow(x[at], got.column("y").to_numpy()[at].astype(float), sign), odds, threshold)


def measured(rules: Rules, text: Column) -> Column:
    """A struct of ADDED."""

    @F.arrow_udf(_KIND)
    def measure(texts: pa.Array) -> pa.Array:
        return rules(texts)

    return measure(text)


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs with STATISTICS and base_failed; columns with these names are replaced."""
    rules = Rules(grow(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(len(FEATURES))), quality.NO_WORDS)
    return _with(docs, rules, [*STATISTICS, "base_failed"])


def _with(docs: DataFrame, rules: Rules, added: list[str]) -> DataFrame:
    bounded_batches(docs.sparkSession)
    (own,) = free(docs, "_measured")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    return docs.select(*kept, measured(rules, F.col("text")).alias(own)).select(*kept, *(f"{own}.{c}" for c in added))


def judged(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, threshold: float = KEEP, signs: dict[str, int] = SIGNS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability and kept.

    Words are runs of bytes other than ASCII white space.  Kept are documents that
    the fixed limits let pass and the trees give `threshold` or more.  Null and empty
    texts have no words and fail; texts of any length are measured whole; repeated
    rows are judged alike; null doc_ids are judged too.  Without labels of both kinds the limits alone
    decide; an empty table gives no rows.  Columns of docs with the names of
    the results are replaced, all others pass.  doc_id is an integer.
    """
    return _with(docs, fit(docs, labels, labelled, threshold, signs), ADDED)
