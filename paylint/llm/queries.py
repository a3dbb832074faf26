"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bitslices, boosted_rules, chat, decontamination, divergence, jaccard, mixing, pii, quality, substrings, tokens, url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Pages on hosts of this form stand for a list of URLs to block in op1_listed_labels.
LISTED_HOSTS = "spam-%"
#: In op1_url_filter the list has the URLs of pages that hold one of these, as a filter of contents would report them.
LISTED_MARKS = ("%%%", "!!")
TOOLS = {
    "search": [{"name": "query", "type": "string", "required": True}, {"name": "limit", "type": "integer", "minimum": 1, "maximum": 6}, {"name": "filter", "type": "object", "properties": [{"name": "lang", "type": "string", "required": True, "enum": ["en", "de"]}, {"name": "tags", "type": "array", "items": "string"}]}],
    "fetch": [{"name": "id", "type": "integer", "required": True}, {"name": "format", "type": "string", "enum": ["text", "html"]}],
}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All URLs, with those of pages of a certain content as the list: other forms of a listed URL are blocked too."""
    pages = _table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = pages.where(F.contains("html", F.lit(LISTED_MARKS[0])) | F.contains("html", F.lit(LISTED_MARKS[1]))).select("url")
    return url_filter.judge(pages.select("page_id", "url"), rules, listed).select("page_id", "host", "path", "rule", "verdict")


def op1_listed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op1_url_filter, with the list taken from hosts that have a label of that form anywhere."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, rules, listed_pages(pages)).select("page_id", "host", "path", "rule", "verdict")


def listed_pages(pages: DataFrame) -> DataFrame:
    host = url_filter.host_of(F.col("url"))
    return pages.where(host.like(LISTED_HOSTS) | host.like(f"%.{LISTED_HOSTS}")).select("url")


def tool_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of a conversation's turns: an assistant's turn calls a tool, the user's next turn is the result.

    A call uses the result of the assistant's turn before, each third also that of
    the one before it, some none, and some one that comes only later, with which
    they make a cycle or not.  Some repeat an identifier.  Some have an unknown tool,
    broken or nested arguments, or a wrong format; some turns of users answer a call
    that was never made.
    """
    rule = lambda n, r=0: (F.coalesce("conv_id", F.lit(0)) * 5 + F.col("turn")) % n == r
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    turn = F.col("turn")
    parents = F.array(F.when((turn >= 2) & ~rule(6), name(turn - 2)), F.when((turn >= 4) & rule(3), name(turn - 4)), F.when(rule(19) | rule(23, 1), name(turn + 2)))
    broken = F.concat(F.lit('{"query":'), turn.cast("string"), F.lit(',"limit":0,"id":"x"}'))
    nested = F.to_json(F.struct(F.col("text").alias("query"), F.struct(F.when(rule(2), "en").otherwise("fr").alias("lang"), F.array(F.lit("a"), F.lit("b")).alias("tags")).alias("filter"), F.lit("c").alias("id")))
    plain = F.to_json(F.struct(F.col("text").alias("query"), turn.alias("limit"), F.col("conv_id").alias("id"), F.when(rule(10), "pdf").otherwise("text").alias("format")))
    calls = conversations.where("role = 'assistant'").select(
        "conv_id",
        F.when(rule(17) & (turn >= 2), name(turn - 2)).otherwise(name(turn)).alias("call_id"),
        "turn",
        F.filter(parents, lambda p: p.isNotNull()).alias("parents"),
        F.when(rule(11), "draw").when(turn % 4 == 1, "search").otherwise("fetch").alias("name"),
        F.when(rule(7), broken).when(rule(8, 1), nested).when(rule(29), "not {json").otherwise(plain).alias("arguments"),
    )
    number = F.when(rule(13), turn + 1000).otherwise(turn - 1)
    results = conversations.where("role = 'user' and turn > 0").select("conv_id", name(number).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_turns(_table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, TOOLS)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslices.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.removed(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.judged(docs, _table(spark, sf_dir, "labels"), text=False)


def op9_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find(docs, pii.train(docs)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return boosted_rules.judged(docs, _table(spark, sf_dir, "labels")).drop("text")


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.compared(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op11_quality_rules measures and fails before its trees, which SQL can express."""
    return boosted_rules.text_statistics(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_url_filter, op1_listed_labels, op2_tool_calls, op3_token_ids, op4_ngram_jaccard, op5_bit_sliced_top_k, op6_substring_dedup, op7_poisson_mix, op8_quality_classifier, op9_pii_crf, op10_decontamination, op11_quality_rules, op12_source_divergence, op13_cross_tokenizer, text_statistics, pipeline)
    return {f.__name__: f for f in ops}


_URL_PARTS = """
parts AS (SELECT page_id, url, html,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, html FROM pages))"""

OP1 = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {', '.join(repr(r) for r in RULES)}), {_URL_PARTS},
fit AS (SELECT p.url, max_by(rhost || rpath, length(rhost || rpath) * 10000 + length(rhost)) AS rule, max_by(rverdict, length(rhost || rpath) * 10000 + length(rhost)) AS rverdict
  FROM (SELECT DISTINCT url, host, path FROM parts) p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.url),
listed AS (SELECT DISTINCT host || rtrim(path, '/') AS c FROM parts WHERE {' OR '.join(f"contains(html, '{m}')" for m in LISTED_MARKS)})
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.rverdict, CASE WHEN host <> '' AND host || rtrim(path, '/') IN (SELECT c FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fit ON parts.url = fit.url"""

OP1_LABELS = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {', '.join(repr(r) for r in RULES)}), {_URL_PARTS},
fit AS (SELECT p.url, max_by(rhost || rpath, length(rhost || rpath) * 10000 + length(rhost)) AS rule, max_by(rverdict, length(rhost || rpath) * 10000 + length(rhost)) AS rverdict
  FROM (SELECT DISTINCT url, host, path FROM parts) p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.url),
listed AS (SELECT DISTINCT host || rtrim(path, '/') AS c FROM parts WHERE len(list_filter(string_split(host, '.'), lambda x: starts_with(x, 'spam-'))) > 0)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.rverdict, CASE WHEN host <> '' AND host || rtrim(path, '/') IN (SELECT c FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fit ON parts.url = fit.url"""

OP4 = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT sizes.doc_id AS doc_id, n AS n_shingles, m AS component_id FROM sizes JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) r ON r.doc_id = sizes.doc_id"""

OP5 = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5"""

OP6 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
covered AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS k FROM covered),
gones AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
cut AS (SELECT words.doc_id AS doc_id, w, CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(ks, p[2])), lambda p: p[1]) END AS kept
  FROM words LEFT JOIN gones USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM cut"""

OP7 = """
WITH sizes AS (SELECT source, CAST(sum(length(text)) AS DOUBLE) AS size FROM documents GROUP BY source),
sums AS (SELECT sum(pow(size, 0.5)) AS w, sum(size) AS s FROM sizes),
rates AS (SELECT source, pow(size, 0.5) * s / w / size AS rate FROM sizes, sums),
drawn AS (SELECT d.*, rate, CAST('0x' || substr(md5('mix:' || doc_id || ':1'), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents d JOIN rates USING (source)),
counted AS (SELECT *, len(list_filter(list_transform(range(0, 30), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-rate) * pow(rate, j) / factorial(CAST(j AS INTEGER))))), lambda c: c <= u)) AS n FROM drawn)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5('mix:' || doc_id || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)"""

TEXT_STATISTICS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY r),
counted AS (SELECT words.r AS r, doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM words LEFT JOIN covered ON covered.r = words.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted"""

OP12 = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
held AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM held GROUP BY lang, term HAVING count(*) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, sum(n) AS n FROM held GROUP BY ALL),
counts AS (SELECT g.lang AS lang, g.source AS source, k.term AS term, coalesce(o.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
totals AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
p AS MATERIALIZED (SELECT c.lang AS lang, c.source AS source, c.term AS term, c.n AS n, 1 + CAST(1000000000 AS HUGEINT) * (c.n + 1) // (t.n + l.v) AS p
  FROM counts c JOIN totals t ON t.lang = c.lang AND t.source = c.source JOIN langs l ON l.lang = c.lang),
q AS (SELECT k.lang AS lang, k.term AS term, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (l.n + l.v) AS q FROM kept k JOIN langs l ON l.lang = k.lang),
pairs AS (SELECT a.lang AS lang, a.source AS source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT x.lang AS lang, x.source AS source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang AS lang, p.source AS source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM numbered WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op1_listed_labels": OP1_LABELS, "op4_ngram_jaccard": OP4, "op5_bit_sliced_top_k": OP5, "op6_substring_dedup": OP6, "op7_poisson_mix": OP7, "text_statistics": TEXT_STATISTICS, "op12_source_divergence": OP12}
