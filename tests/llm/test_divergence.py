import random
import re
from collections import Counter

import duckdb
import numpy as np

from schemaweave.llm import divergence as D

SF = "/root/testdata/sf0.001"


def brute(rows, least_docs, top):
    """The definition, over (lang, source, text)."""
    docs = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        df, total, by = Counter(), Counter(), {}
        for _, source, text in own:
            c = Counter(terms(text))
            df.update(c.keys())
            by.setdefault(source, Counter()).update(c)
        kept = [t for t in df if df[t] >= least_docs]
        for c in by.values():
            total.update({t: c[t] for t in kept})
        p = lambda c, n, t: 1 + 10**9 * (c[t] + 1) // (n + len(kept))
        size = {s: sum(c[t] for t in kept) for s, c in by.items()}
        for s, c in by.items():
            pair, term = [], []
            for o, co in by.items():
                if o != s:
                    pair.append((-sum((p(c, size[s], t) - p(co, size[o], t)) ** 2 // p(co, size[o], t) for t in kept), o.encode(), o))
            for t in kept:
                x, q = p(c, size[s], t), p(total, sum(total.values()), t)
                if c[t] and x > q:
                    term.append((-((x - q) ** 2 // q), t.encode(), t))
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def test_skyband_is_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, k = int(rng.integers(0, 90)), int(rng.integers(1, 9))
        g, o = rng.integers(0, 7, n), rng.integers(0, 9, n)
        want = [sum(g[u] >= g[t] and o[u] <= o[t] for u in range(t)) < k for t in range(n)]
        assert D.skyband(g, o, k, block=int(rng.integers(1, 20))).tolist() == want
        cut = int(rng.integers(0, n + 1))  # a group that arrives in two batches
        first = D.skyband(g[:cut], o[:cut], k, block=5)
        later = D.skyband(g[cut:], o[cut:], k, (g[:cut][first], o[:cut][first]), block=5)
        assert first.tolist() + later.tolist() == want


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, rank int, item string")


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "B", "é", "É", "ßx", "日本", "k9z", "don't", "zz", "Zz", "aa-bb", "\u0080x", "𝒳", "é"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "ü", None, "", "s10"]),
             rng.choice([None, "", "1 2 3"]) if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for _ in range(150)]
    rows += [("xx", "only", "lonely words"), ("yy", "p", "one two"), ("yy", "q", None), ("zz", "p", "same same"), ("zz", "p", "same"), ("zz", "q", "same")]
    rows += rows[:20]  # repeated rows are documents of their own
    for least, top in ((3, 200), (1, 5), (3, 1)):
        got = D.source_divergence(documents(spark, rows).repartition(7), least, top, fan=2).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, least, top)
    assert D.source_divergence(documents(spark, rows).limit(0)).collect() == []


def test_very_long_text_and_hot_source(spark):
    rows = [("en", "hot", "the " * 50_000 + f"word{chr(97 + i % 5)}") for i in range(30)] + [("en", "b", "the other"), ("en", "b", "the other worda")]
    got = D.source_divergence(documents(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 200)


def test_flushes_and_blocks_change_nothing(spark):
    rows = [("en", s, t) for s, t in zip("abcabcabcd" * 6, ["x y z", "y z", "z z x", "w x y", "é w"] * 12)]
    docs = documents(spark, rows).select("lang", "source", "text")
    whole = Counter()
    for r in D.term_counts(docs, held=2).collect():
        whole[r.source, r.term] += r.n
    assert whole == Counter((s, w) for _, s, t in rows for w in t.split())
    kept = spark.createDataFrame([("en", t, s, i + 1, 1) for i, t in enumerate("pqr") for s in "abcde"], "lang string, term string, source string, p long, p0 long")
    pairs = lambda most: sorted(tuple(r) for r in D.shared_terms(kept.coalesce(1).sortWithinPartitions("lang", "term"), most).groupBy("lang", "a", "b").sum("value").collect())
    assert pairs(1) == pairs(7) == pairs(1000) and len(pairs(1)) == 20


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(D.ORACLE).fetchall()
    got = D.op11_source_divergence(spark, SF).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 1000
