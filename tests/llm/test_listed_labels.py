import re

import duckdb

from paylint.llm import bloom, queries, url_filter


def test_list_is_not_empty(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    assert queries.listed_pages(pages).count() == 20


def test_labels_in_front(spark, tmp_path):
    rows = [(1, "http://www.spam-a.org/p?q"), (2, "http://spam-a.net/"), (3, "http://notspam-a.org/p"), (4, "http://m.spam-a.com/"), (5, None), (1, "http://www.spam-a.org/p/")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op1_listed_labels(spark, str(tmp_path))
    assert sorted((r["page_id"], r["verdict"]) for r in got.collect()) == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow")]


def test_many_rules_and_a_shuffled_filter(spark, monkeypatch):
    """Paths that end inside a name, hosts without a dot, filters too large to broadcast; against all rules in turn."""
    monkeypatch.setattr(bloom, "MAX_BLOCKS", 0)
    monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", 0)
    urls = [f"http://{h}{p}" for h in ("a.b.example.com", "example.com", "com", "b.org", "", ".com", "x..com") for p in ("", "/", "/en", "/en/", "/english/x", "/en/x/y/", "/en/x/yz?q", "/a//b")]
    rules = [(h, p, v) for i, h in enumerate(("com", "example.com", "b.example.com", "org", "b.org")) for j, p in enumerate(("", "/", "/e", "/en/x/y", "/english", "/a//")) for v in [("allow", "block")[(i + j) % 2]] if (i + j) % 5]

    def wanted(u):
        host, path = url_filter_parts(u)
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fits)[3:] if fits else (None, "block" if host and host + path.rstrip("/") == "b.org/en" else "allow"))

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([("ftp://B.org/en//?x",), (None,)], "url string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["rule"], r["verdict"]) == wanted(urls[r["page_id"]]), r


def url_filter_parts(u):
    rest = re.split("[?#]", u.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def test_list_blocks_other_forms_of_a_url(spark, tmp_path):
    rows = [(1, "http://a.org/p?q", "good"), (2, "https://A.org/p/#x", "bad %%% html"), (3, "http://a.org/p2", "x"), (4, None, "%%%"), (5, "http://c.com/z", "!!"), (6, "http://b.org/p", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op1_url_filter(spark, str(tmp_path))
    assert sorted((r["page_id"], r["verdict"]) for r in got.collect()) == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow"), (6, "allow")]
    assert queries.op1_url_filter(spark, "/root/testdata/sf0.001").where("rule is null and verdict = 'block'").count() > 0


def test_same_as_sql(spark):
    sf_dir = "/root/testdata/sf0.1"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    for query, sql in ((queries.op1_listed_labels, queries.OP1_LABELS), (queries.op1_url_filter, queries.OP1)):
        wanted = db.execute(sql).fetchall()
        got = query(spark, sf_dir).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted)) and got
