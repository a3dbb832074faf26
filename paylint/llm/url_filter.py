"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .storage import free

#: Entry tables of at most this many rows are broadcast for the exact join; longer ones are shuffled.
BROADCAST_ENTRIES = 100_000


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.call_function("substring", url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host and path without trailing slashes; scheme, query and fragment don't count. Null without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, _cut_slashes(path_of(url))))


def _cut_slashes(path: Column) -> Column:
    """Without slashes at the end, in one pass however many there are."""
    return F.rtrim(path, F.lit("/"))


def _levels(rules: DataFrame, level: str) -> list[int]:
    """The different values of a count of parts, at most as many as the longest rule has parts."""
    return sorted(r[0] for r in rules.select(F.expr(level).alias("n")).distinct().collect())


def _labels(host: str) -> str:
    return f"length({host}) - length(replace({host}, '.', '')) + 1"


def _slashes(path: str) -> str:
    return f"length({path}) - length(replace({path}, '/', ''))"


def _up_to(levels: list[int], most: str) -> Column:
    """A row for each of the levels that is `most` at most."""
    known = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    return F.explode(F.filter(known, lambda n: n <= F.expr(most)))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (host, path, verdict).  A rule fits its host and all subdomains when the
    page's path starts with the rule's; the longest rule string wins, then the one
    with the longer host.  listed: (url), blocked where no rule fits and the
    canonical URL is the same.  All other pages are allowed.

    Rules and listed URLs are entries of one blocked Bloom filter.  A rule's key is
    its host and its path up to the last slash.  A distinct URL probes the filter
    with its canonical form, then with the suffixes of its host that have as many
    labels as some rule's host, and behind the hosts that pass with the prefixes of its
    path that have as many slashes as some rule's path.  Each probe is a row of its
    own with a hash, so a URL of any length takes no more at a time than its own
    size.  Possible hits meet the entries in an exact hash join, after which the rest
    of a rule's path is compared.  The driver sees the number of entries, and the
    different numbers of labels and slashes of rules.

    Null or odd URLs have an empty host and path, no rule and the verdict allow.
    Repeated rows stay, an empty table gives no rows.  Columns of pages named host,
    path, rule or verdict are replaced.  Null rules, and rules that repeat, don't
    matter; of rules that differ only in the verdict, block wins.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    own, entry = free(pages, "_url", "_entry")
    cut = F.regexp_extract("path", "^(.*/)?", 0)
    entries = rules.select(
        F.concat(F.lit("r:"), "host", cut).alias("key"),
        F.col("path").alias("rest"),
        F.struct(F.lit(True).alias("is_rule"), F.length(F.concat("host", "path")).alias("long"), F.length("host").alias("host_long"), (F.col("verdict") == "block").alias("blocks"), F.concat("host", "path").alias("rule"), "verdict").alias("entry"),
    )
    if listed is not None:
        entries = entries.unionByName(
            listed.select(F.concat(F.lit("u:"), canonical(F.col("url"))).alias("key")).where("key is not null").distinct().select("key", F.lit("").alias("rest"), F.struct(F.lit(False).alias("is_rule"), F.lit(0).alias("long"), F.lit(0).alias("host_long"), F.lit(True).alias("blocks"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")).alias("entry"))
        )
    # hosts alone are keys that let a URL's paths be probed, and no entries to be found
    hosts_alone = rules.select(F.concat(F.lit("h:"), "host").alias("key"), F.lit("").alias("rest")).distinct()
    entries = entries.unionByName(hosts_alone, allowMissingColumns=True)
    n = entries.count()
    blocks = bloom.blocks_for(n, bloom.MOST_BLOCKS)
    filter_ = bloom.build(entries, F.xxhash64("key"), blocks)

    urls = pages.select(F.col(url).alias("_url")).where("_url is not null").distinct()
    parts = urls.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    possible = lambda df: bloom.possible(df, F.xxhash64("key"), filter_, blocks)
    urls_probed = possible(parts.select("_url", "_path", F.concat(F.lit("u:"), canonical(F.col("_url"))).alias("key")).where("key is not null"))
    hosts = parts.select("_url", "_host", "_path", _up_to(_levels(rules, _labels("host")), _labels("_host")).alias("_n"))
    hosts = possible(hosts.select("_url", "_path", F.expr("substring_index(_host, '.', -_n)").alias("_suffix")).withColumn("key", F.concat(F.lit("h:"), "_suffix")))
    paths = hosts.select("_url", "_path", "_suffix", _up_to(_levels(rules, _slashes("path")), _slashes("_path")).alias("_n"))
    prefix = F.expr("if(_n = 0, '', concat(substring_index(_path, '/', _n), '/'))")
    hits = urls_probed.unionByName(possible(paths.select("_url", "_path", F.concat(F.lit("r:"), "_suffix", prefix).alias("key"))))
    entries = entries.where("entry is not null")
    found = hits.join(F.broadcast(entries) if n <= BROADCAST_ENTRIES else entries.hint("shuffle_hash"), "key").where(F.startswith("_path", "rest"))
    verdicts = found.groupBy("_url").agg(F.max("entry").alias(entry)).withColumnRenamed("_url", own)
    return pages.select(*kept).join(verdicts, F.col(url) == F.col(own), "left").select(
        *kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(f"{entry}.rule").alias("rule"), F.coalesce(f"{entry}.verdict", F.lit("allow")).alias("verdict")
    )
