"""Long URLs, many levels of rules and empty tables, against a plain version."""

import re

from paylint.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/a", "block"), ("", "/x", "block"), ("a.b.c.d.net", "", "allow"), ("a.b.c.d.net", "/1/2/3/4/5", "block")]
LONG = "http://" + ".".join(["sub"] * 10_000) + ".example.com/en/" + "/".join(["part"] * 10_000) + "?q"
URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/", "http://x.example.com/en", "http://www.example.com/en/x/y", "http://net/es/", "http://q.net/fr/abc/d", "http://q.net/fr/b", "http://a.b.c.d.net/1/2/3/4/567",
    "http://a.b.c.d.net", "http://z.a.b.c.d.net/?x=/es/", "://host/x", "http:///x", LONG, LONG, LONG.replace("example.com", "example.org"), "http://h.org/" + "/" * 100_000 + "x", "http://h.org/" + "/" * 100_000, "http://h.org", "http://" + "y" * 100_000 + ".net/fr/a",
]


def plain(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if url is None:
        fits = []
    best = max(fits, default=None)
    if best:
        return host, path, best[3], best[4]
    return host, path, None, "block" if host and host + path.rstrip("/") in listed else "allow"


def test_long_urls_equal_a_plain_version(spark):
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, path string")
    listed = spark.createDataFrame([("https://h.org",), (None,), ("none",), (URLS[17],)], "url string")
    canonical = {"h.org", plain(URLS[17], [], set())[0] + plain(URLS[17], [], set())[1]}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules, listed).collect()}
    known = [r for r in RULES if r[0]]
    for i, u in enumerate(URLS):
        if u is not None and "://" in u and plain(u, known, canonical)[0] == "":
            continue  # an empty host, which only the rule without a host fits
        assert got[i] == plain(u, known, canonical), u and u[:60]
    assert len(got) == len(URLS)


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, rules, pages.select("url")).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(some, rules.limit(0), pages.select("url")).collect()] == ["allow"]
