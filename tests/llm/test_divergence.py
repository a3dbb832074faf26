import re
from collections import Counter, defaultdict

from paylint.llm import divergence


def plain(rows, least=3, top=200, scale=10**9):
    """The contract with Python's integers. rows: (text, lang, source)."""
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang].add(source)
        held[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)

        def probabilities(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept)
            return {t: 1 + scale * (counts[t] + 1) // (total + v) for t in kept}

        p = {s: probabilities(held[lang, s]) for s in sources}
        q = probabilities(sum((held[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if held[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(sorted(found)[:most], 1)}
    return out


def run(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def small():
    words = ["Alpha", "beta", "GAMMA", "delta-x", "été", "Été", "日本", "zeta9zeta", "a_b"]
    rows = []
    for i in range(120):
        text = " ".join(words[(i * k + k * k) % (5 + i % 5)] for k in range(i % 11))
        rows.append((text, ["en", "de", None][i % 3], ["s1", "s2", "s3", "", None][i % 5]))
    rows += [("only here", "fr", "one"), ("only here", "fr", "one"), (None, "fr", "two"), ("", "es", "solo"), ("x y", None, "late")]
    return rows + rows[:7]


SCHEMA = "text string, lang string, source string, digest int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)


def test_equals_a_plain_version_with_nulls_ties_and_repeated_rows(spark):
    rows = small()
    assert run(divergence.audit(frame(spark, rows))) == plain(rows)
    assert run(divergence.audit(frame(spark, rows), least=1, top=2, scale=1000)) == plain(rows, 1, 2, 1000)


def test_colliding_digests_are_split_by_their_strings(spark):
    rows = small()
    for n in (1, 3):
        assert run(divergence.audit(frame(spark, rows), bits=n)) == plain(rows)


def test_small_parts_blocks_pieces_and_flushes_change_nothing(spark, monkeypatch):
    rows = small()
    for name, value in (("ENTRIES", 7), ("BLOCK", 2), ("HELD", 2), ("BROADCAST_GROUPS", 0), ("SPLIT", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert run(divergence.audit(frame(spark, rows))) == plain(rows)
    assert run(divergence.audit(frame(spark, rows), bits=2)) == plain(rows)


def test_long_terms_and_texts(spark):
    rows = [("x" * 70_000 + " " + "y" * n + " tail" * 5_000, "en", f"s{n % 2}") for n in (63, 64, 65, 66, 8, 16)] * 3
    assert run(divergence.audit(frame(spark, rows))) == plain(rows)


def test_long_division_is_exact():
    import numpy as np

    n, total = np.array([1, 5, 10**13, 7, 8 * 10**15]), np.array([3, 5, 3 * 10**13, 8 * 10**15, 8 * 10**15 + 1])
    assert divergence._scaled(n, total, 10**9).tolist() == [10**9 * a // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]


def test_empty_tables_and_tables_without_terms(spark):
    assert run(divergence.audit(frame(spark, []))) == set()
    rows = [("1 2 3", "en", "a"), (None, "en", "b")]
    assert run(divergence.audit(frame(spark, rows))) == plain(rows) != set()
