"""Mixing sources to target weights: Poisson replication, then a global shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free, saved

#: Sources with statistics of at most this many rows are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: A mean above this is drawn as a sum of independent parts of at most this mean.
PART = 16.0
#: Terms of the inverted distribution: P(count > 128 | mean 16) is below 1e-60.
TERMS = 128


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: 52 bits, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, *seed: Column) -> Column:
    """The inverted Poisson distribution at hash-seeded numbers: the count of k with P(X <= k) <= u, summed over parts."""
    parts = F.greatest(F.ceil(mean / PART), F.lit(1)).cast("int")

    def drawn(j: Column) -> Column:
        m = mean / parts
        start = F.struct(F.exp(-m).alias("p"), F.exp(-m).alias("cdf"), F.lit(0).alias("n"), uniform(*seed, j.cast("string")).alias("u"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * m / k
            return F.when(s["cdf"] <= s["u"], F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["n"] + 1).alias("n"), s["u"].alias("u"))).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["n"])

    return F.when(mean > 0, F.aggregate(F.transform(F.sequence(F.lit(1), parts), drawn), F.lit(0), lambda a, x: a + x)).otherwise(0)


def rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, size: Column | None = None, total: float | None = None) -> DataFrame:
    """(source, rate): the mean number of copies a document of the source gets.

    weights: (source, weight), any scale; without it, a source weighs its size to
    the given power (below 1, small sources gain).  size: what is weighed (the
    number of characters unless given).  total: the size wanted, that of docs
    unless given.  A source without weight gets the rate 0; a null source is a
    source of its own.
    """
    sizes = saved(docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text") if size is None else size, F.lit(0))).cast("double").alias("size")), "sizes")
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(power)))
    else:
        w = weights.groupBy("source").agg(F.sum("weight").cast("double").alias("weight"))
        weighed = sizes.join(w.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = weighed.where("size > 0").agg(F.sum("weight").alias("w"), F.sum("size").alias("s")).first()
    all_weight, all_size = float(sums["w"] or 0), float(sums["s"] or 0) if total is None else float(total)
    rate = F.col("weight") * F.lit(all_size) / F.lit(all_weight) / F.col("size") if all_weight else F.lit(0.0)
    return weighed.select("source", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, seed: str = "mix", total: float | None = None) -> DataFrame:
    """docs with every row repeated Poisson(rate of its source) times, in a global random order; adds copy (from 1) and shuffle_key.

    The draw depends on seed and doc_id (and, for a null doc_id, on the text), so a
    lost task draws the same again; rows with equal doc_id get equal counts.  The
    only shuffle of texts deals rows by the hash of (seed, doc_id, copy), which no
    hot source can skew; inside a partition rows are sorted by that hash.  Empty
    tables give empty results; columns named copy, rate or shuffle_key are replaced,
    all others pass.  Null and empty texts have no size; texts travel whole.
    """
    docs = docs.drop("copy", "rate", "shuffle_key")
    source, rate, at, one = free(docs, "_source", "_rate", "_at", "_one")
    r = rates(docs, weights, power, total=total).withColumnsRenamed({"source": source, "rate": rate})
    small = r.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rated = docs.join(F.broadcast(r) if small else r, F.col("source").eqNullSafe(F.col(source)), "left")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    n_copies = poisson(F.coalesce(rate, F.lit(0.0)), F.lit(seed), key)
    names = [F.col(f"`{c}`") for c in docs.columns]
    copies = rated.select(*names, F.posexplode(F.array_repeat(F.lit(1), n_copies)).alias(at, one))
    keyed = copies.select(*names, (F.col(at) + 1).alias("copy")).withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), key, F.col("copy").cast("string"))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")
