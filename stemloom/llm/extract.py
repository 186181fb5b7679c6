"""Main text of web pages by the best-scoring contiguous region."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Most labelled pages from which the weights are learned, the first in the order of a hash.
FIT_PAGES = 2_000
#: What a word earns where nothing is known of it, the unit of all scores, and what a tag costs at most.
WORD = 1.0
#: A tag costs this much at least, a word of a content section earns this much at least.
LEAST = 0.1
#: What a tag, or a word of boilerplate, costs at most within a section of content: a menu or a
#: notice inside an article is left out of its text, but doesn't cut it in two. A hundred of these
#: cost no more than the word that earns least.
WITHIN = LEAST / 100
#: A word of its own weight is seen so often outside content, and so much more often there than inside.
SEEN, MUCH = 20, 2.0
# Names of HTML elements by their role, and words in classes and ids of boilerplate.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "button")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SECTIONS = frozenset("article aside body details dialog div figure footer form head header html main menu nav section title".split())
CONTENT = frozenset(("article", "main"))
BOILERPLATE = frozenset(("aside", "dialog", "footer", "form", "head", "header", "menu", "nav", "title"))
HINTS = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|copyright|disqus|foot|footer|header|login|menu|modal|nav\w*|newsletter|notices?|outbrain|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|taboola|toolbar|widget",
    re.I,
)
#: Words that say what kind of box it is, after a word that says what is in it.
BOX = frozenset("area articles bar block box button buttons column container form group icons inner items left links list message overlay panel posts right row section text top widget widgets wrap wrapper".split())
#: Words that begin the name of a state of the page, not of a part of it.
STATE = frozenset("has have hide is no non not show with without".split())
# Headings of reader comments, and words of copyright lines.
COMMENTS = re.compile(
    r"\s*(?:(?:\d+|no|one)\s+(?:\w+\s+)?(?:comments?|responses?|repl(?:y|ies)|kommentare?|antworten|comentarios?|respuestas?|commentaires?|réponses?)(?:\s+(?:yet|on|to|zu|auf|a|en|sur|à)\b.*)?|(?:comments?|responses|replies|kommentare|comentarios|commentaires)(?:\s*\(\d+\))?|(?:leave|post|write) a (?:reply|comment).*)\s*:?\s*",
    re.I | re.S,
)
RIGHTS = re.compile(r"all rights reserved|alle rechte vorbehalten|todos los derechos reservados|tous droits réservés|^\s*(?:©|&copy;|\(c\)|copyright)\s+(?:©|&copy;|\(c\)|\d{4})", re.I)
#: Most words of a copyright line.
LINE = 40
#: What holds more than one in so many of a page's words is no boilerplate by its class, nor a form, dialog or head.
MOST_OF = 2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open one of these names, and the elements at which the search for it stops.
ENDED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",))}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_CLASS = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _key(name: str, attrs: str) -> str:
    """An element's kind: its name, with its classes and id."""
    found = _CLASS.findall(attrs) if attrs else ()
    return name + "".join("." + x.lower() for f in found for x in " ".join(f).split()) if found else name


NEVER = 1 << 62


class Node:
    """An open element: what it is, what it is in, and what words in it score."""

    __slots__ = ("content", "cut", "key", "name", "parent", "score", "section", "words")

    def __init__(self, parent: Node | None, name: str, key: str):
        self.parent, self.name, self.key = parent, name, key
        #: In content that an element marks as such.
        self.content = name in CONTENT or parent is not None and parent.content
        #: The innermost element around it that holds a part of the page.
        self.section = key if name in SECTIONS or parent is None else parent.section
        self.score: tuple[float, bool] = (WORD, False) if parent is None else parent.score
        #: Words in it, and the token of the page from which on it is boilerplate.
        self.words, self.cut = 0, NEVER


def tokens(page: str) -> Iterator[tuple[str, str, Node]]:
    """(kind, value, element) of each tag and text outside comments, scripts and styles.

    kind is "open", "close" or "text"; element is the innermost open one, a start tag's its own. An end
    tag closes what was opened after its start tag; one without a start tag closes nothing, and one of an
    element that holds no part of the page closes none that does. Each tag takes constant time on average,
    however deep the elements nest.
    """
    at = Node(None, "", "")
    opened: Counter = Counter()

    def close(names: tuple[str, ...], until: frozenset | tuple[str, ...]) -> Node:
        if not any(opened[n] for n in names):
            return at
        node, passed = at, []
        while node.parent is not None and node.name not in names:
            if node.name in until:
                return at
            passed.append(node.name)
            node = node.parent
        if node.parent is None:
            return at
        opened.subtract([*passed, node.name])
        return node.parent

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            yield "text", text, at
        elif name := m["name"]:
            name = name.lower()
            if m["close"]:
                yield "close", name, at
                at = close((name,), () if name in SECTIONS else SECTIONS)
            else:
                if name in ENDED:
                    at = close(*ENDED[name])
                if name in BLOCKS:
                    at = close(("p",), SECTIONS)
                node = Node(at, name, _key(name, m["attrs"]))
                if name not in VOID and not m["attrs"].endswith("/"):
                    at = node
                    opened[name] += 1
                yield "open", name, node


def _names_boilerplate(cls: str) -> bool:
    """Whether a class, as a whole, names a box of boilerplate: by its head, the last word that isn't a kind of box.

    So post-sidebar and ad-block do; has-sidebar, header-content, comments-open and ad-free don't.
    """
    parts = [x for x in re.split(r"[-_]+", cls) if x]
    if not parts or parts[0] in STATE:
        return False
    head = next((x for x in reversed(parts) if x not in BOX), "")
    return bool(HINTS.fullmatch(head) or len(parts) == 1 and HINTS.fullmatch(parts[0]))


@lru_cache(100_000)
def _role(key: str) -> int:
    """1 for a section of content, -1 for boilerplate by its name, -2 by its class, 0 for neither."""
    name, *classes = key.split(".")
    if name in CONTENT:
        return 1
    if name in BOILERPLATE:
        return -1
    return -2 if name not in HEADINGS and any(map(_names_boilerplate, classes)) else 0


def count_labelled(page: str) -> Counter:
    """(kind of token, in content) of a page whose content an article or main element marks."""
    out: Counter = Counter()
    for kind, value, node in tokens(page):
        if kind == "text":
            words = value.split()
            if words:
                out["word@" + node.section, node.content] += len(words)
                out.update({("class:" + c, node.content): len(words) for c in node.section.split(".")[1:]})
                out.update(("text:" + w, node.content) for w in entities.unescape(value).lower().split() if len(w) <= 40)
        else:
            out["tag:" + value, node.content] += 1
    return out


class Weights:
    """Scores of words and tags: log odds of a token in content against elsewhere, in units of a word.

    A tag costs from LEAST to WORD, and a word earns or costs as much, so both are on one scale: a line
    with as many tags as words is worth nothing, one of linked words is worth less than one of plain words.
    """

    def __init__(self, counts: dict[tuple[str, bool], int]):
        kinds = {k for k, _ in counts if not k.startswith(("text:", "class:"))}
        total = {x: sum(n for (k, y), n in counts.items() if y == x and k in kinds) + len(kinds) + 1 for x in (False, True)}
        self.odds = {k: self._odds(counts, total, k) for k, _ in counts if not k.startswith("text:")}
        words = {x: sum(n for (k, y), n in counts.items() if y == x and k[:5] == "text:") + 1 for x in (False, True)}
        own = {k: self._odds(counts, words, k) for (k, x), n in counts.items() if not x and k[:5] == "text:" and n >= SEEN}
        #: Words of what stands around content, and what each scores.
        self.around = {k[5:]: x for k, x in own.items() if x < -MUCH}

    @staticmethod
    def _odds(counts: dict[tuple[str, bool], int], total: dict[bool, int], k: str) -> float:
        return math.log((counts.get((k, True), 0) + 0.5) / total[True] * total[False] / (counts.get((k, False), 0) + 0.5))

    def of_element(self, key: str) -> float | None:
        """The log odds of words in elements of this kind; of an unknown kind, those of its most telling class."""
        known = self.odds.get("word@" + key)
        if known is None and "." in key:
            return max((x for c in key.split(".")[1:] if (x := self.odds.get("class:" + c)) is not None), key=abs, default=None)
        return known

    def state(self, node: Node, total: int) -> tuple[float, bool]:
        """(what a word scores, in boilerplate) in an element: what its own kind says, else as around it.

        `total` is the number of the page's words. What holds most of them is the page or its frame:
        neither a class nor what was learned of such elements makes it boilerplate.
        """
        found, boiler = node.parent.score
        role, odds = _role(node.key), self.of_element(node.key)
        frame = node.name in ("html", "body") or node.words * MOST_OF > total
        if role < 0 and frame and (role == -2 or node.name in ("form", "header", "dialog")):
            role = 0
        if role < 0 and node.name == "header" and node.parent.content:
            return found, boiler  # the head of an article is a part of it
        if role:
            boiler = boiler or role < 0
            found = min(-WORD, odds or -WORD) if boiler else max(LEAST, odds or WORD)
        elif odds is not None and "." in node.key and not node.parent.content and not (frame and odds < 0):
            found = -WORD if boiler or odds < 0 else WORD
        return found, boiler

    def words(self, text: str, node: Node) -> float:
        """What the words of a text score together."""
        words = text.split()
        if not words:
            return 0.0
        found = node.score[0]
        if node.content:
            return len(words) * max(found, -WITHIN)
        if found > 0 and self.around:
            return found * sum(self.around.get(w, WORD) for w in entities.unescape(text).lower().split())
        return len(words) * found

    def tag(self, name: str, node: Node) -> float:
        """A tag's cost; no tag earns anything."""
        if node.content:
            return -WITHIN
        return max(-WORD, min(-LEAST, self.odds.get("tag:" + name, -LEAST)))


def _reader_comments(seen: list[tuple[str, str, Node]]) -> None:
    """Mark what follows a heading of reader comments within the element that the heading stands in."""
    heading, began, text = None, 0, []
    for k, (kind, value, node) in enumerate(seen):
        if kind == "open" and value in HEADINGS:
            heading, began, text = node, k, []
        elif heading is not None:
            if kind == "text":
                text.append(value)
            elif kind == "close" and value in HEADINGS:
                if heading.parent is not None and COMMENTS.fullmatch(entities.unescape("".join(text))):
                    heading.parent.cut = min(heading.parent.cut, began)
                heading = None


def judge(seen: list[tuple[str, str, Node]], weights: Weights) -> None:
    """Give each element of a page its score, with what the whole page shows."""
    total = 0
    for kind, value, node in seen:
        if kind == "text":
            n = len(value.split())
            node.words += n
            total += n
    nodes = [node for kind, _, node in seen if kind == "open"]
    for node in reversed(nodes):
        node.parent.words += node.words
    _reader_comments(seen)
    lines: set[Node] = set()
    for kind, value, node in seen:
        if kind == "text" and not node.content and RIGHTS.search(value):
            while node.parent is not None and node.name not in BLOCKS:
                node = node.parent
            if node.words <= LINE and node.words * MOST_OF <= total:
                lines.add(node)
    for k, (kind, _, node) in enumerate(seen):
        if kind == "open":
            node.score = weights.state(node, total)
            if node in lines or k >= node.parent.cut:
                node.score = (min(-WORD, node.score[0]), True)


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best-scoring contiguous region of tokens, joined by empty lines.

    One scan keeps the best sum that ends at each token. Text of boilerplate sections inside the
    region is left out; nothing else is dropped.
    """
    if not page:
        return ""
    seen = list(tokens(page))
    judge(seen, weights)
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, (kind, value, node) in enumerate(seen):
        if kind == "text":
            score = weights.words(value, node) if k < node.cut else -WORD * len(value.split())
        else:
            score = weights.tag(value, node)
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, span = total, (start, k + 1)
    blocks: list[str] = []
    parts: list[str] = []

    def end() -> None:
        if block := " ".join(entities.unescape("".join(parts)).split()):
            blocks.append(block)
        parts.clear()

    for k, (kind, value, node) in enumerate(seen[span[0] : span[1]], span[0]):
        if kind == "text":
            if node.score[0] > 0 and k < node.cut:
                parts.append(value)
        elif value in BLOCKS:
            end()
        elif value == "br":
            parts.append(" ")
    end()
    return "\n\n".join(blocks)


def learn(pages: DataFrame, most: int = FIT_PAGES) -> Weights:
    """Weights from at most `most` pages that mark their content with one article or main element.

    Such pages label themselves. Only counts by kind of token come to the driver: no more kinds than
    these pages have, and of words only those that occur SEEN times around content.
    """
    x = pages.select(F.col("`page_id`").alias("id"), F.col("`html`").alias("html"))
    ids = x.filter(F.regexp_count("html", F.lit(r"(?i)<(article|main)[\s>]")) == 1).select("id").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(most)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: Counter = Counter()
            for page in b["html"]:
                if page:
                    total.update(count_labelled(page))
            yield pd.DataFrame([(k, x, n) for (k, x), n in total.items()], columns=["kind", "inside", "n"])

    # `most` ids at most
    counts = x.join(F.broadcast(ids), "id", "left_semi").mapInPandas(count, "kind string, inside boolean, n long")
    sums = counts.groupBy("kind").agg(*[F.sum(F.when(F.col("inside") == x, F.col("n")).otherwise(0)).alias(c) for c, x in (("i", True), ("o", False))])
    word = F.col("kind").startswith("text:")
    rows = sums.filter(~word | (F.col("o") >= SEEN)).collect()
    rest = sums.filter(word & (F.col("o") < SEEN)).agg(F.lit("text:").alias("kind"), F.sum("i").alias("i"), F.sum("o").alias("o")).collect()
    return Weights({(r.kind, x): n or 0 for r in [*rows, *rest] for x, n in ((True, r.i), (False, r.o))})


def extracted(page: Column, weights: Weights) -> Column:
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, weights) for p in batch], dtype=object)

    return extract.asNondeterministic()(page)  # else a filter above runs it again


def extract(pages: DataFrame, most: int = FIT_PAGES) -> DataFrame:
    """(row, text) of each page: the article, without what stands around it.

    Null and empty pages, and pages without any content, give an empty text; broken markup is read as
    far as it goes; repeated rows are read each; an empty table gives an empty result; all columns
    travel in `row`.
    """
    weights = learn(pages, most)
    x = pages.select(T.packed(pages), F.col("`html`").alias("html"))
    return x.withColumn("text", extracted(F.col("html"), weights)).select("row", "text")


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    x = pages.withColumn("text", extracted(F.col("html"), learn(pages)))
    return x.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
