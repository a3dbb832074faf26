"""Quality classifier: text evidence combined with host and path posteriors by hierarchical empirical Bayes.

A document is good if its label says quality 1 and not toxic 1.  The evidence of a
text comes from a logistic regression over surface rates and over what its words
say: each word (by hash) has the log odds of bad documents among the labelled ones
that hold it, shrunk toward none where few do.  Words are weighed on one half of the
labelled documents and the regression is fitted on the other, so that it sees words
as they occur in texts that did not weigh them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import split, utf8
from .storage import bounded_batches, saved

#: Labelled documents the text classifier is fitted on, at most: those with the smallest hash of doc_id.
LABELLED = 20_000
#: Site tables of at most this many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_SITES = 100_000
#: Texts are measured in pieces of about so many bytes at a time.
PIECE = 1 << 20
#: Evidence of one document counts for at most so many log odds.
MOST = 12.0
KEEP = 0.5

_UPPER, _LETTER, _SYMBOL, _DIGIT, _LINE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL[list(b"!*#$%&|<>{}\\^~_=")] = True
_DIGIT[48:58] = True
_LINE[10] = True
FEATURES = ("log_words", "distinct", "repeated", "commonest", "upper", "symbols", "digits", "lines", "length", "bad_words", "word_odds")
#: Words are told apart by so many bits of their hash.
BITS = 18
#: A word's odds are those of so many documents of the usual kind, and of the documents that hold it; words in fewer than LEAST say nothing.
SHRINK, LEAST = 10.0, 6
#: From these odds on a word counts as bad.
BAD = 1.5
NO_WORDS = np.zeros(1 << BITS, np.float32)


def features(texts: pa.Array, odds: np.ndarray = NO_WORDS) -> np.ndarray:
    """(texts, FEATURES): rates that stay finite for empty texts and are damped for short ones; odds: those of words by hash."""
    data, offsets = utf8(texts)
    out, row = [], 0
    while row < len(texts):
        to = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1))
        out.append(_features(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], odds))
        row = to
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _features(data: np.ndarray, offsets: np.ndarray, odds: np.ndarray) -> np.ndarray:
    def count(where: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(where, dtype=np.int64)])[at]).astype(float)

    w = split(data, offsets)
    h, n = w.hashes(), w.n.astype(float)
    distinct, top, bad, said = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for i, (a, z) in enumerate(zip(w.of[:-1].tolist(), w.of[1:].tolist(), strict=True)):
        if z > a:
            s = np.sort(h[a:z])
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct[i], top[i] = len(first) - 1, np.diff(first).max()
            each = odds[_bucket(s[first[:-1]])]
            bad[i], said[i] = min(each[each >= BAD].sum(), 12.0), each.sum()
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[w.of[:-1][w.n > 0]] = False
    letters = count(_LETTER[data])
    return np.stack(
        [np.log1p(n), (distinct + 10) / (n + 10), count(same, w.of) / (n + 10), np.maximum(top - 1, 0) / (n + 10), count(_UPPER[data]) / (letters + 20), count(_SYMBOL[data]) / (n + 10), count(_DIGIT[data]) / (n + 10), count(_LINE[data]) / (n + 10), np.minimum(np.diff(offsets) / (n + 10), 100), bad, said / (distinct + 10)],
        axis=1,
    )


class Evidence:
    """A ridge logistic regression over the features and their squares, given the words' odds; log odds are clipped to MOST either way."""

    def __init__(self, x: np.ndarray, y: np.ndarray, odds: np.ndarray = NO_WORDS, ridge: float = 1.0):
        both = len(set(y.tolist())) == 2
        self.odds = odds
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        z = self._inputs(x)
        self.weights = np.zeros(z.shape[1])
        if not both:
            # without both classes there is no evidence either way
            return
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            slope = z.T @ (p - y) + ridge * self.weights
            bend = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
            step = np.linalg.solve(bend, slope)
            self.weights -= step
            if np.abs(step).max() < 1e-6:
                break

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._inputs(x) @ self.weights, -MOST, MOST)


def goods(labels: DataFrame) -> DataFrame:
    """(doc_id, good): 1 for quality 1 and not toxic 1, else 0; rows without quality 0 or 1 don't count, of several labels the best does."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    good = F.when((F.col("quality") == 1) & (toxic != 1), 1).otherwise(0)
    return labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(good).alias("good"))


def chosen(labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, good) of `labelled` labels at most, those with the smallest hash of doc_id: few enough to be broadcast."""
    return saved(goods(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "labels")


def fit(docs: DataFrame, good: DataFrame) -> Evidence:
    """The text classifier from labels (doc_id, good), as chosen() gives them.

    They are broadcast to the scan of docs.  Their texts are written once; the driver gets one row of
    features for each label, and one count for each of 2^BITS hashes of words.  Of
    rows with equal doc_id that with the least text counts.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(good.withColumnRenamed("doc_id", "_doc")), F.col("doc_id") == F.col("_doc")).groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    rows = saved(rows.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))), "labelled")
    odds = _odds(rows.where("half = 0"))

    def measured(batches):
        for b in batches:
            x = features(b.column(0), odds)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), pa.array(x.ravel())), b.column(1), b.column(2)], ["x", "y", "doc"])

    got = rows.where("half = 1").select("text", "good", "doc_id").mapInArrow(measured, "x array<double>, y int, doc long").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    # summing in the order of doc_id, the fit doesn't depend on which task ends first
    at = np.argsort(got.column("doc").to_numpy(), kind="stable")
    return Evidence(x[at], got.column("y").to_numpy()[at].astype(float), odds)


def _odds(rows: DataFrame) -> np.ndarray:
    """For each hash of a word the log odds of bad documents among those of rows (text, good) that hold it, against those of all."""

    def counted(batches):
        n = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy()
            data, offsets = utf8(batch.column(0))
            w = split(data, offsets)
            at = _bucket(w.hashes()) if len(w.start) else np.zeros(0, np.int64)
            for i, (a, z) in enumerate(zip(w.of[:-1].tolist(), w.of[1:].tolist(), strict=True)):
                n[good[i], np.unique(at[a:z])] += 1
        held = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[0, held]), pa.array(n[1, held])], ["bucket", "bad", "good"])

    sums = rows.select("text", "good").mapInArrow(counted, "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    every = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("good")).alias("bad")).first()
    out = np.zeros(1 << BITS, np.float32)
    share = ((every["bad"] or 0) + 0.5) / (every["n"] + 1)
    bad, n = sums.column("bad").to_numpy(), sums.column("bad").to_numpy() + sums.column("good").to_numpy()
    p = (bad + SHRINK * share) / (n + SHRINK)
    out[sums.column("bucket").to_numpy()] = np.where(n >= LEAST, np.log(p / (1 - p)) - np.log(share / (1 - share)), 0)
    return out


def evidence(model: Evidence, text: Column) -> Column:
    @F.arrow_udf("double")
    def log_odds(texts: pa.Array) -> pa.Array:
        return pa.array(model.log_odds(features(texts, model.odds)))

    return log_odds(text)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _between(total: dict, sums: DataFrame, mean: Column) -> float:
    """How many documents' worth of evidence the parent's mean counts for: the within-site variance by that between sites (Buehlmann)."""
    s = sums.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, F.lit(2.0))).alias("spread"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("k"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within")).first()
    n, k = float(total["n"] or 0), s["k"]
    if n <= k or not k:
        return 1e6
    within = max(s["within"] / (n - k), 1e-9)
    free = n - s["nn"] / n
    between = (s["spread"] - (k - 1) * within) / free if free > 0 else 0.0
    return float(min(1e6, max(1.0, within / between))) if between > 0 else 1e6


def sites(scored: DataFrame) -> DataFrame:
    """(host, path, n, s, host_mean, path_mean, host_strength, path_strength, prior): posteriors of host and path, shrunk toward their parents.

    scored: (host, path, p), p the probability of a document, or 0 or 1 if it has a
    label.  n and s are the documents of a path and the sum of p.  A host's mean is
    (s + k m) / (n + k) with the global mean m, a path's the same with its host's
    posterior mean; both k are estimated by moments over all sites.  Sums combine
    before they are shuffled, so hot hosts don't gather; the driver sees totals only.
    """
    # rounded sums don't depend on the order in which they are added up
    exact = lambda c: F.sum(F.round(c * F.lit(1e6)).cast("long")) / F.lit(1e6)
    p = F.col("p")
    by_path = saved(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), exact(p).alias("s"), exact(p * p).alias("ss")), "paths")
    total = by_path.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first().asDict()
    prior = (float(total["s"] or 0) + 0.5) / (float(total["n"] or 0) + 1.0)
    hosts = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    k_host = _between(total, hosts, F.lit(prior))
    hosts = saved(hosts.select(F.col("host").alias("_host"), ((F.col("s") + k_host * prior) / (F.col("n") + k_host)).alias("host_mean")), "hosts")
    both = by_path.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    k_path = _between(total, both, F.col("host_mean"))
    return saved(both.select("host", "path", "n", "s", "host_mean", ((F.col("s") + k_path * F.col("host_mean")) / (F.col("n") + k_path)).alias("path_mean"), F.lit(k_host).alias("host_strength"), F.lit(k_path).alias("path_strength"), F.lit(prior).alias("prior")), "sites")


#: The columns that judged() adds.
ADDED = ("log_odds", "host_posterior", "path_posterior", "probability", "keep")


def judged(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column = "lang", labelled: int = LABELLED, threshold: float = KEEP, text: bool = True) -> DataFrame:
    """docs with log_odds, host_posterior, path_posterior, probability and keep; without text, if the results don't need it.

    The log odds of a document are its text's evidence plus how far its path's
    posterior, without the document itself, is from the global mean; keep means a
    probability of the threshold or more.  A document with one of the labels that
    the classifier is fitted on (`labelled` at most, those with the smallest hash of
    doc_id) counts in the posteriors of its sites with its label, any other with the
    probability of its text.  Null hosts and paths are sites of their own.  Null and empty texts are
    measured as texts without words, texts of any length as a whole.  Repeated rows
    are judged alike.  Without labels of both kinds texts give no evidence; an empty
    table gives no rows.  Columns of docs with the names of the results are
    replaced, all others pass, whatever their names are.
    """
    host = F.col(host) if isinstance(host, str) else host
    path = F.col(path) if isinstance(path, str) else path
    names = [c for c in docs.columns if c not in ADDED and (text or c != "text")]
    kept = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    good = chosen(labels, labelled)
    rows = docs.select(kept, F.col("doc_id").cast("long").alias("doc"), host.alias("host"), path.alias("path"), evidence(fit(docs, good), F.col("text")).alias("e"))
    return combined(rows, good, threshold).select("row.*", *ADDED)


def combined(rows: DataFrame, good: DataFrame, threshold: float = KEEP) -> DataFrame:
    """rows (row, doc, host, path, e: log odds of the text) with the results, given labels (doc_id, good) few enough to be broadcast. Texts are measured once: rows are written first."""
    rows = saved(rows.join(F.broadcast(good.withColumnRenamed("doc_id", "_doc")), F.col("doc") == F.col("_doc"), "left").drop("_doc"), "evidence")
    own = F.coalesce(F.col("good").cast("double"), 1 / (1 + F.exp(-F.col("e"))))
    at = sites(rows.select("host", "path", own.alias("p"))).withColumnsRenamed({"host": "_host", "path": "_path"})
    at = F.broadcast(at) if at.count() <= BROADCAST_SITES else at
    joined = rows.join(at, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    others = (F.greatest(F.col("s") - own, F.lit(0.0)) + F.col("path_strength") * F.col("host_mean")) / (F.greatest(F.col("n") - 1, F.lit(0)) + F.col("path_strength"))
    bounded = F.least(F.greatest(others, F.lit(1e-4)), F.lit(1 - 1e-4))
    out = joined.select("row", "doc", (F.col("e") + _logit(bounded) - _logit(F.col("prior"))).alias("log_odds"), F.col("host_mean").alias("host_posterior"), F.col("path_mean").alias("path_posterior"))
    probability = 1 / (1 + F.exp(-F.col("log_odds")))
    return out.withColumn("probability", probability).withColumn("keep", F.col("probability") >= threshold)
