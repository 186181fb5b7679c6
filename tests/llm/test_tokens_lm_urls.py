"""Token counts, token files, language-model scores and URL verdicts against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stemloom.llm import lm, tokencount, tokenindex, urls

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "plain words, and 'll it's 12,345 más allá  \n\n x"), (2, None), (3, ""), (4, " \t\n "), (5, "a <|endoftext|> b<|endoftext|>"),
    (6, "é̂ ﬁne 東京   end  "), (7, "same text here"), (7, "same text here"), (7, "another text"), (None, "no id"), (None, None), (10, "He'LL ''s ÀÉ µª²¼ ß\xad x1234 \xa0y\x85z"), (11, "ΣΑΣ İ <|ENDoftext|> <|endoftext|>a\x1cb"), (8, "word " * 30_000), (9, "x" * 20_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "de", 5) for i, t in ODD], "doc_id long, text string, TH string, pieces int")


def _all(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def _key(rows):
    return sorted(tuple("~" if x is None else x for x in map(str, r)) for r in rows)


def _want_counts(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out.append((i, len((text or "").encode()), n, n > 512))
    return _key(out)


def test_token_counts_of_odd_texts(odd):
    assert _key(tokencount.count_tokens(odd).collect()) == _want_counts(ODD)


def test_token_counts_without_a_head(odd):
    assert _key(tokencount.count_tokens(odd, head=3).collect()) == _want_counts(ODD)


def test_token_counts_of_the_table(spark):
    assert _key(tokencount.op2_tokencount(spark, SF).collect()) == _want_counts(_all(spark))


def test_token_counts_of_an_empty_table(odd):
    assert tokencount.count_tokens(odd.limit(0)).count() == 0


def _want_files(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows]
    start, out = 0, []
    for i, x in ids:
        out.append((i, start, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())))
        start += len(x)
    return out


def test_token_files_of_the_table(spark):
    got = tokenindex.op7_tokens(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert _key(got) == _key(_want_files(sorted(_all(spark))))


def test_token_files_of_odd_rows(spark, odd, tmp_path):
    tokenindex.write(odd, str(tmp_path / "x"))
    got = sorted(tokenindex.read(spark, str(tmp_path / "x")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _ in ODD], key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    want = Counter((i, n, c) for i, _, n, c in _want_files(ODD))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_keyed_lookup(spark, odd, tmp_path):
    tokenindex.write(odd, str(tmp_path / "x"))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = Counter((r.doc_id, tuple(r.ids)) for r in tokenindex.lookup(spark, str(tmp_path / "x"), [7, 1, 99, -5]).collect())
    assert got == Counter((i, (*t.encode(x or "", add_special_tokens=False).ids, 2)) for i, x in ODD if i in (1, 7))


def test_a_lookup_reads_little(spark, tmp_path):
    """Of 12 MB of ids, one key's page and its index, not the files."""
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "ne") for b in ("ra", "to", "su", "vi")]
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(words, 1500))) for k in range(2500)]
    path = str(tmp_path / "x")
    tokenindex.write(spark.createDataFrame(rows, "doc_id long, text string"), path)
    total = sum(f.stat().st_size for f in (tmp_path / "x").glob("*.parquet"))
    assert spark.read.parquet(path).count() > 100
    stats = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem

    def read():
        return sum(s.getBytesRead() for s in stats.getAllStatistics() if s.getScheme() == "file")

    tokenindex.lookup(spark, path, [3]).collect()
    before = read()
    got = tokenindex.lookup(spark, path, [1234, 5_000_000]).collect()
    assert [r.doc_id for r in got] == [1234] and total > 2_000_000 and read() - before < 1_000_000


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 5000).astype(np.uint64))
    mph = tokenindex.PerfectHash.build(keys)
    assert sorted(mph(keys)) == list(range(len(keys)))


def test_token_files_of_an_empty_table(spark, odd, tmp_path):
    tokenindex.write(odd.limit(0), str(tmp_path / "x"))
    assert tokenindex.read(spark, str(tmp_path / "x")).count() == 0


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*_WORD.findall(lower), None]


def _base(rows):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    c = Counter(w for i, t in rows if fold(i) != 1 for w in _words(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = _words(t)
        out.append((i, fold(i) == 1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    return _key(out)


def _got_base(df):
    return _key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


@pytest.mark.parametrize("head", [100, 500_000])
def test_base_scores(spark, head):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert _got_base(lm.score_corpus(docs, 64, head)) == _base(_all(spark))


def test_base_scores_of_odd_texts(odd):
    assert _got_base(lm.score_corpus(odd)) == _base(ODD)


def test_scores_of_an_empty_table(odd):
    assert lm.score_corpus(odd.limit(0)).count() == 0


def test_model_beats_the_base_on_held_out_texts(spark):
    held = lm.op3_lm(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_do_not_depend_on_the_head(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a = {r.doc_id: r.score for r in lm.score_corpus(docs, 64, 100).collect()}
    b = {r.doc_id: r.score for r in lm.score_corpus(docs, 64, 500_000).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 * abs(a[k]) for k in a)


# page 2 fits no rule; half of its host's pages are blocked, so the method blocks it too
URLS = [
    (1, "http://Example.NET/en/x?q", "example.net", "/en/x", "example.net/en/", "allow"), (2, "https://a.net#f", "a.net", "", None, "block"),
    (3, "https://a.net/", "a.net", "/", "net/", "block"), (4, "http://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
    (5, "x.org/fr/", "", "", None, "allow"), (6, None, "", "", None, "allow"), (7, "http://x.org/fr/y", "x.org", "/fr/y", "org/fr/", "allow"),
    (8, "http://myexample.com/de/", "myexample.com", "/de/", None, "allow"), (9, "http://sub.example.net/de/", "sub.example.net", "/de/", "net/", "block"), (10, "", "", "", None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u, *_ in URLS], "page_id long, url string, html string, host string")
    got = sorted((r.row.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect())
    assert got == [(i, h, p, rule, v) for i, _, h, p, rule, v in URLS]


def test_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_propagation_against_a_dense_matrix(spark):
    rng = np.random.default_rng(3)
    n, edges = 12, {}
    for a, b in rng.integers(0, 12, (40, 2)):
        if a != b:
            edges[int(a), int(b)] = int(rng.integers(1, 4))
    seeds = {0: 1.0, 5: 0.5}
    e = spark.createDataFrame([(f"h{a}", f"h{b}", k) for (a, b), k in edges.items()], "src string, dst string, n long")
    s = spark.createDataFrame([(f"h{a}", x) for a, x in seeds.items()], "host string, seed double")
    got = {r.host: r.score for r in urls._propagated(e, s, 20, 0.85).collect()}
    m = np.zeros((n, n))
    for (a, b), k in edges.items():
        m[a, b] = k
    out = m.sum(1, keepdims=True)
    m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    s0 = np.array([seeds.get(k, 0.0) for k in range(n)])
    r = s0.copy()
    for _ in range(20):
        r = 0.85 * r @ m + 0.15 * s0
    r *= s0.sum() / r.sum()
    assert all(abs(got.get(f"h{k}", 0.0) - r[k]) < 1e-9 for k in range(n))


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    link = lambda *u: "".join(f'<a href="{x}">x</a>' for x in u)
    rows = [(1, "http://bad.net/", ""), (2, "http://spam.io/", link("http://bad.net/a", "http://bad.net/b")), (3, "http://good.org/fr/", link("http://fine.io/")), (4, "http://fine.io/", None)]
    got = {r.row.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


@pytest.mark.parametrize("k", [1, 2, 10, 1_000])
def test_distrust_does_not_thin_out_with_the_number_of_linkers(spark, k):
    link = lambda n: "".join(f'<a href="http://u{j}.io/">x</a>' for j in range(n)) + '<a href="http://bad.net/">x</a>'
    rows = [(0, "http://bad.net/", ""), *[(j, f"http://s{j}.io/", link(0)) for j in range(1, k + 1)], (-1, "http://portal.io/", link(9))]
    got = {r.row.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "block", -1: "allow", **{j: "block" for j in range(1, k + 1)}}


def test_pairs_of_all_words_count(spark):
    rows = [(i, f"rare{i % 40} tail{i % 40} " * 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.doc_id: r.score for r in lm.score_corpus(docs, v, h).collect()} for v, h in ((4, 20), (4, 500_000), (4_096, 500_000))]
    assert all(abs(a[k] - got[2][k]) < 1e-6 * abs(got[2][k]) for a in got for k in got[2])
    # each word but the first is certain after the one before it
    assert all(x > 3.5 * -math.log10(40) for x in got[0].values())


def _plain_model(rows):
    """Deleted interpolation written out: {doc_id: score}, the estimate p(w | h), its words, and held-out likelihoods by round."""
    words = {i: [*(t or "").split(), ""] for i, t in rows}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in words}
    pairs = [(i, h, w) for i, ws in words.items() for h, w in zip(["<s>", *ws], ws)]
    count = lambda on: (Counter(w for i, _, w in pairs if on(fold[i])), Counter((h, w) for i, h, w in pairs if on(fold[i])))
    (c1, c2), (r1, r2), (_, h2) = count(lambda f: f != 1), count(lambda f: f not in (1, 2)), count(lambda f: f == 2)
    c1["<s>"], r1["<s>"] = c1[""], r1[""]
    n, kinds, n_rest, v_rest = sum(c1.values()) - c1[""], len([w for w in c1 if w != "<s>" and c1[w]]), sum(r1.values()) - r1[""], len([w for w in r1 if w != "<s>" and r1[w]])
    bucket = lambda c: int(math.log2(c + 1))
    weights, likelihood = {}, []
    for _ in range(12):
        got, total = {}, 0.0
        for (h, w), times in h2.items():
            a = weights.get(bucket(c1[h]), (1 / 3,) * 3)
            p = [a[0] * r2[h, w] / max(r1[h], 1), a[1] * r1[w] / n_rest, a[2] / (v_rest + 1)]
            total += times * math.log(sum(p))
            e = got.setdefault(bucket(c1[h]), [1e-3] * 3)
            for k in range(3):
                e[k] += times * p[k] / sum(p)
        weights = {b: tuple(x / sum(e) for x in e) for b, e in got.items()}
        likelihood.append(total)
    last = (1 / 3,) * 3
    for b in range(60):
        last = weights.setdefault(b, last)
    lost = [x / sum(weights[0][1:]) for x in weights[0][1:]]

    def p(h, w):
        a = weights[bucket(c1[h])] if c1[h] else (0, *lost)
        return a[0] * c2[h, w] / max(c1[h], 1) + a[1] * c1[w] / n + a[2] / (kinds + 1)

    return {i: sum(math.log10(p(h, w)) for j, h, w in pairs if j == i) for i in words}, p, [w for w in c1 if w != "<s>" and c1[w]], likelihood


@pytest.mark.parametrize(("vocabulary", "head"), [(3, 8), (3, 500_000), (2_048, 500_000)])
def test_scores_by_brute_force(spark, vocabulary, head):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 40)).clip(max=60))) for i in range(150)]
    rows.append((150, None))
    want, p, known, likelihood = _plain_model(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_corpus(docs, vocabulary, head).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6
    assert all(b > a - 0.01 for a, b in zip(likelihood, likelihood[1:], strict=False))  # each round explains held-out texts better
    for h in ("<s>", known[0], known[-1], "never seen"):
        assert abs(sum(p(h, w) for w in known) + p(h, "another unknown word") - 1) < 1e-9
