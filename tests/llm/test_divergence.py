"""Divergence of sources against plain sums over all terms, and against DuckDB."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stemloom.llm import divergence
from tests.oracle import assert_same, duck

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least=30, top=50):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        found = TERM.findall(lower(text))
        n[g].update(found)
        df[g[0]].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, k in df[lang].items() if k >= least]
        mine = sorted(g for g in groups if g[0] == lang)
        whole = sum((n[g] for g in mine), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = share(n[lang, source]), share(whole)
        pairs = []
        for g in mine:
            if g[1] != source:
                o = share(n[g])
                pairs.append((g[1], sum(abs(p[t] - o[t]) for t in kept)))
        terms = [(t, p[t] - q[t]) for t in kept if n[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    words = ["the", "THE", "Élan", "élan", "東京", "x1y", "a-b", "\x85z", "İ", "ﬁ", "don't"] + [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    rows = []
    for k in range(260):
        lang, source = rng.choice(["de", "en", None, ""]), rng.choice(["s1", "s10", "S2", "hot", "hot", None, "é"])
        rows.append((" ".join(rng.choice(words[: 8 + 9 * (len(source or "") % 4)]) for _ in range(rng.randrange(40))), lang, source))
    rows += [(None, "de", "only nulls"), ("", "xx", "a"), ("never often", "xx", "b"), ("12 34", "xx", "c"), ("alone", "yy", "z"), ("rare " + "the " * 9000, "de", "long")]
    rows += [("same words of copies", "en", "hot")] * 40
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "no", 1, 2) for r in rows], "text string, lang string, source string, TERM string, n int, p long").repartition(5)


def test_odd_rows(spark, odd):
    assert rows_of(divergence.audit(frame(spark, odd))) == plain(odd)


def test_bounds_are_parameters(spark, odd):
    assert rows_of(divergence.audit(frame(spark, odd), least=3, top=4)) == plain(odd, 3, 4)


def test_a_full_sketch_changes_no_result(spark, odd):
    """Four cells let every term through, as a table far larger than the sketch would."""
    assert rows_of(divergence.audit(frame(spark, odd), width=4, depth=2)) == plain(odd)


def test_sketch_never_underestimates_and_rules_terms_out(spark, odd):
    docs = frame(spark, odd).select("text", *[divergence.F.coalesce(c, divergence.F.lit("")).alias(c) for c in ("lang", "source")])
    df, got = defaultdict(Counter), set()
    for text, lang, _ in odd:
        df[lang or ""].update(set(TERM.findall(lower(text))))
    found = Counter()
    for r in divergence.counts(docs.na.fill(""), least=30).collect():
        got.add((r.lang, r.term))
        found[r.lang, r.term] += r.df
    often = {(lang, t): k for lang, c in df.items() for t, k in c.items() if k >= 30}
    assert set(often) <= got and all(found[k] == v for k, v in often.items())
    assert len(got) < sum(map(len, df.values()))


def test_large_frequencies_do_not_overflow(spark):
    docs = spark.createDataFrame([("a a b", "x", "s")] * 700 + [("a", "x", "t")] * 300, "text string, lang string, source string").coalesce(1)
    assert rows_of(divergence.audit(docs)) == plain([tuple(r) for r in docs.collect()])
    assert {r.term for r in divergence.counts(docs, least=900).collect()} == {"a"}


def test_empty_tables(spark, odd):
    empty = frame(spark, odd).limit(0)
    assert divergence.audit(empty).count() == 0
    none = frame(spark, [(None, None, None), (None, None, "b"), ("one", None, "b")])
    assert rows_of(divergence.audit(none)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_terms_of_sliced_columns():
    column = pa.array(["x", None, "Aß1b ÇÉ", ""], pa.string()).slice(1)
    assert divergence.terms_only(column).to_pylist() == [None, "aß b ÇÉ", ""]
    assert divergence.terms_only(pa.array([], pa.string())).to_pylist() == []


def test_share_is_exact(spark):
    big = 10**17 + 3
    x = spark.createDataFrame([(big, 3 * big, 10**9)], "n long, total long, terms long").select(divergence.share("n", "total", "terms").alias("p")).first().p
    assert x == 1 + 10**9 * (big + 5) // (3 * big + 5 * 10**9)
    assert np.iinfo(np.int64).max > x


def test_whole_table_against_sql(spark):
    assert_same(divergence.op11_divergence(spark, "/root/testdata/sf0.001"), duck("/root/testdata/sf0.001"), divergence.ORACLE_SQL)
