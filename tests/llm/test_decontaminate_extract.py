"""Decontamination and page extraction against brute force."""

import html
import itertools
import re
import time
from collections import Counter

import numpy as np
import pytest

from stemloom.llm import decontaminate, extract
from stemloom.llm import text as T


def toks(t):
    return re.findall(r"\w+", (t or "").lower())


def brute(doc, item):
    """Whether some shift has a stretch of 13 tokens (or the item) with 80 % equal."""
    a, b = toks(doc), toks(item)
    least = min(13, len(b))
    if not b:
        return False
    for shift in range(-len(b) + 1, len(a)):
        eq = [0 <= shift + k < len(a) and a[shift + k] == x for k, x in enumerate(b)]
        ins = [k for k in range(len(b)) if 0 <= shift + k < len(a)]
        for s in ins:
            if eq[s]:
                for e in range(s + least - 1, len(b)):
                    if e in ins and eq[e] and sum(eq[s : e + 1]) >= 0.8 * (e - s + 1) - 1e-9:
                        return True
    return False


def test_finds_planted_passages(spark):
    item = "alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    near = [x if k % 7 != 3 else "changed" for k, x in enumerate(w)]
    far = [x if k % 3 else "changed" for k, x in enumerate(w)]
    docs = [
        (1, "lead in " + item + " and out"), (2, "x " + " ".join(near).upper() + " y"), (3, " ".join(far)), (4, " ".join(w[:8])), (5, None), (6, ""), (7, "one two three in a row"),
        (8, "short item here now"), (1, "lead in " + item + " and out"), (None, "q " * 20000 + item),
    ]
    items = [(10, item), (11, "short item here"), (12, None), (13, "!!"), (10, item)]
    d = spark.createDataFrame([(*r, "a", 1) for r in docs], "doc_id long, text string, item_id string, row int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r[0], r.item_id) for r in decontaminate.find(d, b).select("row.doc_id", "item_id").collect()}
    want = {(i, k) for i, t in docs if len(t or "") < 9999 for k, x in items if brute(t, x)} | {(None, 10)}
    assert got == want and {(1, 10), (2, 10), (8, 11)} <= want and not {(3, 10), (4, 10)} & want
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.find(d.limit(0), b).count() == 0 and decontaminate.find(d, b.limit(0)).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, items = T.documents(spark, d).select("doc_id", "text"), T.table(spark, d, "benchmark")
    one = {tuple(r) for r in decontaminate.find(docs, items).select("row.doc_id", "item_id", "first_token", "n_tokens", "n_equal").collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 2000)
    many = {tuple(r) for r in decontaminate.find(docs, items).select("row.doc_id", "item_id", "first_token", "n_tokens", "n_equal").collect()}
    assert one == many


def test_seeds_ignore_unmarked_places():
    for mask in decontaminate.MASKS:
        a = np.arange(1, len(mask) + 1, dtype=np.uint64)
        for k, m in enumerate(mask):
            b = a.copy()
            b[k] = 99
            assert (decontaminate.seed_hashes(a, mask) == decontaminate.seed_hashes(b, mask)).all() == (m == "0")


def _caught(n, changes):
    """The share of ways to change so many of n tokens, but the first and the last, that still give the overlap."""
    item = np.arange(1, n + 1, dtype=np.uint64)
    seeds, caught, all_ = decontaminate.Seeds([item]), 0, 0
    for places in itertools.combinations(range(1, n - 1), changes):
        doc = item.copy()
        doc[list(places)] = 10_000
        caught += any(x[2] == n for x in decontaminate.overlaps(doc, seeds))
        all_ += 1
    return caught / all_


@pytest.mark.parametrize(("n", "changes"), [(9, 1), (10, 2), (12, 2), (13, 2), (14, 2), (15, 3), (16, 3)])
def test_no_overlap_at_the_share_escapes(n, changes):
    assert _caught(n, changes) == 1


def test_overlaps_of_twenty_tokens():
    assert _caught(20, 4) > 0.999


def test_long_and_repetitive_texts():
    words = np.random.default_rng(0).integers(0, 1 << 60, 60_000).astype(np.uint64)
    seeds = decontaminate.Seeds([words[:50_000]])
    assert list(decontaminate.overlaps(np.concatenate([words[:5], words]), seeds))[-1] == (0, 5, 50_000, 50_000)
    one = np.full(30_000, 7, np.uint64)
    found = list(decontaminate.overlaps(one, decontaminate.Seeds([one[:1_000]])))
    assert len(found) == 30_999 - 2 * 12 and max(x[2] for x in found) == 1_000


@pytest.mark.parametrize(("period", "other"), [(1, 1), (2, 2), (5, 5), (2, 4), (7, 1), (1000, 1000)])
def test_periodic_texts_take_bounded_memory_and_time(period, other):
    import tracemalloc

    doc, item = np.arange(20_000, dtype=np.uint64) % period, np.arange(20_000, dtype=np.uint64) % other
    seeds = decontaminate.Seeds([item])
    began = time.process_time()
    shifts = {x[1] for x in decontaminate.overlaps(doc, seeds)}
    assert time.process_time() - began < 2.5
    tracemalloc.start()
    seeds.hits(doc)
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    if period == other:
        assert len(decontaminate.Seeds([item]).hits(doc)) >= 2 * (19_900 // period) - 1 and 0 in shifts


def test_hits_by_brute_force():
    """Each place of a document and of an item with one seed gives their shift, and nothing else does."""
    rng = np.random.default_rng(4)
    for letters, n in ((2, 60), (3, 120), (1, 40), (30, 200)):
        for _ in range(8):
            items = [np.tile(rng.integers(0, letters, rng.integers(1, 9)), 30)[: rng.integers(13, 90)].astype(np.uint64) for _ in range(3)]
            doc = np.concatenate([rng.integers(0, letters, n).astype(np.uint64), items[0], items[1][5:], items[0]])
            want = set()
            for mask in decontaminate.MASKS:
                mine = decontaminate.seed_hashes(doc, mask)
                for k, x in enumerate(items):
                    own = decontaminate.seed_hashes(x, mask)
                    want |= {(k, int(i - j)) for i, j in zip(*np.nonzero(mine[:, None] == own[None, :]), strict=True)}
            assert {tuple(r) for r in decontaminate.Seeds(items).hits(doc, 500).tolist()} == want


def test_longest_stretch_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(500):
        at = np.flatnonzero(rng.random(rng.integers(0, 50)) < rng.choice([0.5, 0.7, 0.8, 0.9]))
        spans = [(int(a), int(at[j] - a + 1), j - i + 1) for i, a in enumerate(at) for j in range(i, len(at))]
        spans = [x for x in spans if x[1] >= 13 and 5 * x[2] >= 4 * x[1]]
        assert decontaminate._best_stretch(at, 13) == (max(spans, key=lambda x: (x[1], -x[0])) if spans else None)


def article(page):
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    body = re.sub(r"</?(?:p|h1)[^>]*>", "\0", m[1] if m else "")
    body = re.sub(r"<[^>]+>", "", body.replace("<br>", " "))
    return "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in body.split("\0")) if b)


def test_articles(spark):
    d = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in extract.op10_extract(spark, d).collect()}
    pages = T.table(spark, d, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == article(p.html) and got[p.page_id].n_chars == len(article(p.html))


@pytest.fixture(scope="module")
def weights(spark):
    return extract.learn(T.table(spark, "/root/testdata/sf0.001", "pages"))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<nav><a>x</a></nav>", ""), ("<p>only this", "only this"), ("a &lt; b <br> c", "a < b c"),
        ("<main><h1>T</h1><p>Hello <a href=y>link</a> &amp; world.<form><label>Name</label></form><div class=comments>First!</div><p>more</main><footer>f</footer>", "T\n\nHello link & world.\n\nmore"),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no --><p>yes</p>", "yes"),
        ('<div id="cookie-notice">We use cookies and many words here</div><div><p>Some real text of a page.</p></div><div class="sidebar">popular</div>', "Some real text of a page."),
    ],
)
def test_pages(weights, page, want):
    assert extract.main_text(page, weights) == want


LINKED = "".join(f'<p>Short one {i} with <a href="x">a link</a> here now.</p>' for i in range(20))
LINKED_TEXT = "\n\n".join(f"Short one {i} with a link here now." for i in range(20))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="menu"><a>Home</a><a>About</a></div><div class="post">{LINKED}</div><div>\xa9 2024 X. All rights reserved.</div>', LINKED_TEXT),
        (
            f"<body><div><a>Home</a> <a>About</a> <a>Contact</a></div><div><h1>Title of it</h1><p>By Jane Doe</p><p>{'long word ' * 30}</p><ul><li>one thing</li><li>two things here</li></ul><p>A closing paragraph at the end.</p></div><div>&copy; 2024 Company. All rights reserved.</div></body>",
            "Title of it\n\nBy Jane Doe\n\n" + ("long word " * 30).strip() + "\n\none thing\n\ntwo things here\n\nA closing paragraph at the end.",
        ),
        ('<article><h1 class="entry-header">T</h1><p>Text of it.</p><p class="advert">Buy now!<p>More text.</p><p class="share">Share <b>this</b> now</p><ul class="related-posts"><li>x<li>y</ul><p>End.</p></article>', "T\n\nText of it.\n\nMore text.\n\nEnd."),
    ],
)
def test_pages_of_other_layouts(weights, page, want):
    assert extract.main_text(page, weights) == want


THREE = ["Seven plain words stand in this line, and seven more come after them here.", "A second paragraph of the same kind follows with other plain words in it.", "The third one ends the page, as long as both of those before it."]
BODY = "".join(f"<p>{x}</p>" for x in THREE)


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="has-sidebar">{BODY}</body>', f'<body class="page no-sidebar promo-on">{BODY}</body>', f'<div class="container no-sidebar">{BODY}</div>', f'<div id="header-content">{BODY}</div>',
        f'<section class="comments-open">{BODY}</section>', f'<div class="post social-links-on">{BODY}</div>', f'<div id="page" class="page ad-free">{BODY}</div>', f'<main class="widget-area-main"><div class="nav-open">{BODY}</div></main>',
        f'<form id="aspnetForm">{BODY}</form>', f'<body class="sidebar">{BODY}<div class="sidebar">popular posts</div></body>', f'<div class="widget">{BODY}</div><div class="ad-block">Buy it now</div>',
        f'<div class="page-wrapper"><div class="site-header"><a>Home</a></div>{BODY}<div class="related-posts"><a>More</a></div><div id="cookie_notice">We use cookies</div></div>',
    ],
)
def test_classes_of_frames_lose_no_page(weights, page):
    assert extract.main_text(page, weights) == "\n\n".join(THREE)


@pytest.mark.parametrize(
    "rest",
    [
        "<section><h3>3 responses</h3><p>I liked this one very much, thank you.</p><p>Me too, and I read it twice.</p></section>", "<div><h2>Comments (2)</h2><ul><li>First one here!</li><li>Second.</li></ul></div>",
        "<h3>Leave a reply</h3><p>Your address will not be published.</p>", "<div>All rights reserved. Contact us by mail.</div>", "<p>&copy; 2024 Somebody and others</p>",
    ],
)
def test_comments_and_notices_without_classes_go(weights, rest):
    assert extract.main_text(f"<body><div>{BODY}{rest}</div></body>", weights) == "\n\n".join(THREE)
    assert extract.main_text(f"<body><div>{BODY}</div>{rest}</body>", weights) == "\n\n".join(THREE)


def test_pages_without_marks_and_classes(spark, weights):
    """Precision and recall of words, all classes, ids and marks of content taken off."""
    hit = got_n = want_n = 0
    for p in T.table(spark, "/root/testdata/sf0.01", "pages").collect():
        bare = re.sub(r"\s(?:class|id)=(?:\"[^\"]*\"|[^\s>]+)", "", p.html).replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div")
        got, want = Counter(extract.main_text(bare, weights).split()), Counter(article(p.html).split())
        hit, got_n, want_n = hit + (got & want).total(), got_n + got.total(), want_n + want.total()
    print("precision", hit / got_n, "recall", hit / want_n)
    assert hit / got_n > 0.97 and hit / want_n > 0.97


def test_deep_nesting_takes_linear_time(weights):
    began = time.process_time()
    assert extract.main_text("<div>" * 20_000 + "hello world" + "</b></div>" * 20_000, weights) == "hello world"
    assert time.process_time() - began < 3


def test_extract_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<article>" + "word " * 50000 + "</article>", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract.extract(df).select("row.text", "text").collect()
    assert len(got) == 3 and sorted(len(r[1]) for r in got) == [0, 0, 249999]
    assert extract.extract(df.limit(0)).count() == 0
