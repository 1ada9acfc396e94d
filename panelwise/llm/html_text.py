"""Main text of web pages: the best-scoring contiguous region of words and tags.

A page is a sequence of words and tags. Words score positive, tags negative. The weights come from pages that mark their
article: a tag scores the logarithm of its share inside the marked article, a word minus the logarithm of the share of such
words outside; link words have a share of their own. How much a word counts against a tag is chosen on other marked pages, with
their marks ignored, by agreement with the marked words. A linear scan finds the contiguous run with the largest total.

What the region holds of other things (menus, forms, notices, comments) is left out: elements of such a tag, or with such a word in
class, id or role. An element around the main text is never taken for one of them, whatever its name: the region is found
first without regard to names, and an element that holds nearly all of it stays. An article inside a comment block belongs to that.

Output: character references decoded, white space inside a block turned into one space, blocks trimmed and joined by line
feeds in page order. Defined cases: null and empty html give an empty text; so does a page without words of its own; broken
markup (tags that never close, a lone "<", comments without end) is read as far as it goes; each input row gives one row
and keeps its columns; ties go to the earliest region; without any marked page all tags weigh alike. Only html is read, and
page_id with it to pick the pages to learn from; an empty table gives an empty table.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# About so many pages with a marked article are read for the weights; so many of the most frequent tags (with their class names) have
# weights of their own, rarer ones share one.
TRAIN_PAGES, TAGS = 2000, 1000
# Candidates for the weight of a word against tags; the largest of the best is taken, which keeps more of pages with many tags.
SCALES = tuple(2.0 ** k for k in range(-8, 3))
# An element that holds this share of the region found without regard to names is around the main text.
AROUND = 0.8
WORD, LINK_WORD, ANY_TAG = "#word", "#link", "#tag"

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_ENDED_BY_NEXT = {"p", "li", "tr", "td", "th", "dt", "dd", "option"}
_BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre "
    "script section select style summary table tbody td textarea tfoot th thead title tr ul".split())
_FURNITURE_TAGS = set(
    "head script style title nav footer aside form noscript template svg iframe object textarea select button option "
    "dialog menu datalist label input canvas audio video map".split())
_FURNITURE_NAMES = set(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar sidenav "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist reply "
    "replies discussion disqus respond share sharing social related recommended recommendations widget toolbar pagination "
    "pager login signin signup register search searchbox skip copyright complementary contentinfo dialog form".split())
_COMMENT_NAMES = {"comment", "comments", "commentlist", "reply", "replies", "discussion", "disqus", "respond"}
_MARKS = {"article", "main"}
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(slots=True)
class Element:
    name: str
    names: frozenset
    parent: int
    start: int
    end: int = 0
    closed: bool = False


@dataclass(slots=True)
class Page:
    """Tokens (key, text, element) in page order; key is None for text, else the tag; element 0 is the page itself."""
    tokens: list = field(default_factory=list)
    elements: list = field(default_factory=lambda: [Element("", frozenset(), 0, 0)])


def _names(attributes: str) -> frozenset:
    found = (x for m in _NAMES.findall(attributes) for x in _SPLIT.split("".join(m).lower()))
    return frozenset(x for x in found if x)


def parse(page: str) -> Page:
    """Read a page; elements that never close end where an element around them does."""
    out = Page()
    tokens, elements, opened = out.tokens, out.elements, Counter()
    now = pos = at = 0

    def leave(e: int) -> int:
        elements[e].end = len(tokens)
        opened[elements[e].name] -= 1
        return elements[e].parent

    while True:
        m = _TOKEN.search(page, pos)
        text = page[at:m.start()] if m else page[at:]
        if text:
            tokens.append((None, text, now))
        if not m:
            break
        pos = at = m.end()
        if m.group(2) is None:
            continue
        name, rest = m.group(2).lower(), m.group(3)
        if m.group(1):
            if not opened[name]:
                tokens.append(("/" + name, "", now))
                continue
            while elements[now].name != name:
                now = leave(now)
            tokens.append(("/" + name, "", now))
            elements[now].closed = True
            now = leave(now)
            continue
        if name == "body":
            while now and elements[now].name != "html":
                now = leave(now)
        elif name == elements[now].name and name in _ENDED_BY_NEXT or name in _BLOCK and elements[now].name == "p":
            now = leave(now)
        elements.append(Element(name, _names(rest), now, len(tokens)))
        tokens.append((name, "", len(elements) - 1))
        if name in _VOID or rest.rstrip().endswith("/"):
            elements[-1].end = len(tokens)
            continue
        now = len(elements) - 1
        opened[name] += 1
        if name in _RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, pos)
            raw = page[pos:stop.start()] if stop else page[pos:]
            if raw:
                tokens.append((None, raw, now))
            pos = at = stop.end() if stop else len(page)
            now = leave(now)
    while now:
        now = leave(now)
    elements[0].end = len(tokens)
    return out


def _inherited(page: Page, own: list[bool]) -> list[bool]:
    for i, e in enumerate(page.elements):
        if i and own[e.parent]:
            own[i] = True
    return own


def _marks(page: Page) -> tuple[list[int], list[bool]]:
    """The elements that mark an article outside comments, and for each element if it stands in one."""
    comments = _inherited(page, [bool(e.names & _COMMENT_NAMES) and e.name not in ("html", "body") for e in page.elements])
    marks = [i for i, e in enumerate(page.elements) if e.name in _MARKS and not comments[i] and not e.names & _FURNITURE_NAMES]
    own = [False] * len(page.elements)
    for i in marks:
        own[i] = True
    return marks, _inherited(page, own)


def _unread(page: Page) -> list[bool]:
    return _inherited(page, [e.name in _RAW or e.name == "head" for e in page.elements])


def _words(page: Page, skip: list[bool]) -> list[int]:
    return [len(words.split()) if tag is None and not skip[e] else 0 for tag, words, e in page.tokens]


def around(page: Page, a: int, b: int) -> set[int]:
    """Elements that hold nearly all words of the tokens from ``a`` to ``b``."""
    upto = [0, *accumulate(n if a <= i < b else 0 for i, n in enumerate(_words(page, _unread(page))))]
    return {i for i, e in enumerate(page.elements) if upto[e.end] - upto[e.start] >= AROUND * upto[-1] > 0}


def furniture(page: Page, text: set[int]) -> list[bool]:
    """For each element if it is, or stands in, something other than main text.

    Elements of ``text`` are around the main text: their names don't count, nor do their tags if they are a form, or hold other elements and
    never close.
    """
    inside, elements, own = _marks(page)[1], page.elements, []
    for i, e in enumerate(elements):
        named = bool(e.names & _FURNITURE_NAMES) or not inside[i] and "header" in e.names
        tagged = e.name in _FURNITURE_TAGS or e.name == "header" and not inside[i]
        parent = i + 1 < len(elements) and elements[i + 1].parent == i
        wraps = i in text and (not tagged or e.name == "form" or parent and not e.closed)
        own.append((named or tagged) and not wraps and e.name not in ("", "html", "body") or e.name in _RAW)
    return _inherited(page, own)


def _marked(page: Page, unread: list[bool]) -> tuple[int, list[bool]]:
    """The marked article with most words (the earliest of equals), and for each element if it is, or stands in, that; without any, -1."""
    upto = [0, *accumulate(_words(page, unread))]
    spans = [(upto[page.elements[i].end] - upto[page.elements[i].start], -i) for i in _marks(page)[0]]
    main = -max(spans)[1] if spans else -1
    return main, _inherited(page, [i == main for i in range(len(page.elements))])


def _in_links(page: Page) -> list[bool]:
    return _inherited(page, [e.name == "a" for e in page.elements])


def _key(page: Page, tag: str, element: int) -> str:
    e = page.elements[element]
    return ".".join([tag, *sorted(e.names)[:3]]) if tag.lstrip("/") == e.name else tag


def count(text: str) -> Counter:
    """(key, inside the marked article) -> number, whatever the names of elements. The mark's own tags stand outside."""
    page = parse(text)
    unread, links = _unread(page), _in_links(page)
    main, inside = _marked(page, unread)
    out: Counter = Counter()
    for tag, words, e in page.tokens:
        if unread[e]:
            continue
        if tag is None:
            out[(LINK_WORD if links[e] else WORD, inside[e])] += len(words.split())
            continue
        for key in {ANY_TAG, tag, _key(page, tag, e)}:
            out[(key, inside[e] and e != main)] += 1
    return out


def _sample(pages: DataFrame, train_pages: int) -> DataFrame:
    """Marked pages, about ``train_pages`` by a hash of id and text, with ``held`` for every fourth."""
    marked = pages.where(F.lower("html").rlike("<(article|main)[ >]")).select("page_id", "html")
    h = F.xxhash64("page_id", "html")
    draw = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    return marked.where(draw * max(marked.count(), 1) < train_pages).select("html", (F.pmod(F.xxhash64(h), F.lit(4)) == 0).alias("held"))


def weights(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from about ``train_pages`` pages that mark their article; every fourth of them decides the scale of words."""
    sample = _sample(pages, train_pages)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for page in b["html"]:
                total.update(count(page))
        yield pd.DataFrame([(k, i, v) for (k, i), v in total.items()], columns=["key", "inside", "n"])

    counted = sample.where(~F.col("held")).select("html").mapInPandas(counts, "key string, inside boolean, n long")
    rows = counted.groupBy("key").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b")).orderBy(
        ~F.col("key").startswith("#"), F.desc(F.col("a") + F.col("b")), "key").limit(TAGS).collect()
    seen = {r["key"]: (r["a"], r["b"]) for r in rows}
    w = {}
    for key in {*seen, WORD, LINK_WORD, ANY_TAG}:
        a, b = seen.get(key, (0, 0))
        share = (a + 1) / (a + b + 2)
        w[key] = -math.log(1.0 - share) if key in (WORD, LINK_WORD) else math.log(share)

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = dict.fromkeys(SCALES, 0.0)
        for b in batches:
            for page in b["html"]:
                for s, f in agreement(page, w).items():
                    total[s] += f
        yield pd.DataFrame(list(total.items()), columns=["scale", "f"])

    held = sample.where("held").select("html").mapInPandas(agree, "scale double, f double")
    found = {r["scale"]: round(r["f"], 6) for r in held.groupBy("scale").agg(F.sum("f").alias("f")).collect()}
    scale = max((s for s, f in found.items() if f == max(found.values())), default=1.0)
    return {k: v * scale if k in (WORD, LINK_WORD) else v for k, v in w.items()}


def agreement(text: str, w: dict[str, float]) -> dict[float, float]:
    """For each scale of words the F measure of the words found, marks ignored, against the marked words."""
    page = parse(text)
    drop = _unread(page)
    inside, n = _marked(page, drop)[1], _words(page, drop)
    marked = [x if inside[t[2]] else 0 for x, t in zip(n, page.tokens)]
    out = {}
    for s in SCALES:
        a, b = best_region(_scores(page, {k: v * s if k in (WORD, LINK_WORD) else v for k, v in w.items()}, drop, marks=False))
        out[s] = 2.0 * sum(marked[a:b]) / max(1, sum(n[a:b]) + sum(marked))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest total, the earliest of equals; (0, 0) if none is positive."""
    best, run, start, region = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, region = run, (start, i + 1)
    return region


def _scores(page: Page, w: dict[str, float], drop: list[bool], marks: bool = True) -> list[float]:
    links, out = _in_links(page), []
    for tag, words, e in page.tokens:
        if drop[e] or not marks and tag and tag.lstrip("/") in _MARKS:
            out.append(0.0)
        elif tag is None:
            out.append(len(words.split()) * w[LINK_WORD if links[e] else WORD])
        else:
            out.append(w.get(_key(page, tag, e), w.get(tag, w[ANY_TAG])))
    return out


def extract(text: str | None, w: dict[str, float]) -> str:
    page = parse(text or "")
    drop = furniture(page, around(page, *best_region(_scores(page, w, _unread(page)))))
    a, b = best_region(_scores(page, w, drop))
    blocks, now = [], []
    for tag, words, e in page.tokens[a:b]:
        if tag is None:
            if not drop[e]:
                now.append(words)
        elif tag.lstrip("/") in _BLOCK:
            blocks.append(now)
            now = []
    blocks.append(now)
    clean = (" ".join(references.unescape("".join(x)).split()) for x in blocks)
    return "\n".join(x for x in clean if x)


def main_text(pages: DataFrame, w: dict[str, float] | None = None, into: str = "text") -> DataFrame:
    """Add column ``into`` with each page's main text. Without weights they are learned from the pages."""
    w = w or weights(pages)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([extract(x, w) for x in s], dtype=object)

    return pages.withColumn(into, run(F.col("html")))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
