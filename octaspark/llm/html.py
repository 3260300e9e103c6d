"""Operator 4: main text of web pages by a decision tree over flat text blocks.

A page becomes a flat list of text blocks: runs of text between block-level tags, with inline markup dropped.
Blocks in elements whose tag or role is that of a menu, footer, sidebar, form or the like, which are hidden, or whose
class or id names them as such, don't count. A name is judged by whole tokens: all parts of a compound must be
words for such elements or say nothing, and an element that holds the page's main element is never set aside by its
name. Of several articles, those inside another and teasers (small beside the largest) don't count either.

All other blocks are classified by a decision tree that sees a block's number of words and link density, both of the
block before and after it, whether it stands in an article, a main element or neither, the most that the page has
of these, whether it is a heading and whether it reads like a notice. It is grown on the blocks of a few hundred small
pages made by rule (``labelled_pages``), whose main text is known by construction; blocks that are set aside aren't
among its examples, so it must tell the rest by words, links and neighbours.

Character references are decoded, white space inside a block becomes one space, and
main blocks are joined in page order by two line ends. Scripts, styles and templates
are skipped to their end tag, or to the end of the page without one; other elements whose
content isn't text (media, buttons) only if they have an end tag. Work is linear in the page's length.

Defined results: null and empty pages have empty text. A tag that the page's end cuts off
is dropped. Where the tree takes nothing, all that isn't links or a notice counts; where nothing at all would
be left, names don't set aside, and then forms don't.
Equal pages have equal texts. Repeated and very long pages are rows like others. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's element names by what they do here.
RAW = "script style noscript template title textarea".split()
CLOSED = "svg math iframe object select button canvas video audio".split()
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
SPACE = {"br", "td", "th", "option"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ASIDE = {"nav", "aside", "footer", "menu", "dialog", "search", "fieldset"}
#: Elements that end one of their own kind which is still open, up to these.
IMPLIED = {"p": set(), "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}}
# Words of class and id names.
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts "
    "popup modal overlay newsletter subscribe subscription signup login navbar nav navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets related recommended "
    "recommendations share sharing social comment comments commentlist disqus replies reply respond responses opinion opinions feedback discussion discuss talkback guestbook "
    "footer masthead toolbar topbar pagination pager skip search copyright legal disclaimer teaser teasers".split()
)
HEADER_WORDS = {"header", "head", "top"}
ARTICLE_WORDS = {"article", "post", "entry", "story", "content", "main"}
CONTAINER_WORDS = ARTICLE_WORDS | {"body", "text", "page", "news", "blog", "single", "wrapper", "container", "area"}
#: Tokens that by themselves say that an element holds the page or its article.
CONTAINERS = CONTAINER_WORDS | {"wrap", "layout", "site", "hentry", "app", "root", "grid", "row", "document"}
#: Parts of a compound that say nothing about what an element is.
NEUTRAL = set(
    "site main left right top bottom box boxes list bar block area section wrapper wrap container inner outer item items post posts article articles page link links user users reader readers "
    "global primary secondary story stories content slot unit text group panel module col column header head title more my the and cnt js sub entry form icons buttons media news".split()
)
#: A name that starts so tells what an element has or lacks or is about, not what it is; one that ends so tells a state.
MODIFIERS = {"with", "has", "have", "no", "without", "non", "not", "after", "before", "is", "hide", "show", "category", "cat", "tag", "format", "type", "status", "layout", "topic", "theme", "template"}
STATES = {"open", "opened", "closed", "active", "enabled", "disabled", "visible", "collapsed", "expanded", "off", "on", "allowed", "loaded", "ready"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form"}
NOTICE = re.compile(
    r"\u00a9|\(c\) ?\d|\bcopyright\b|all rights reserved|\b(?:uses?|accept(?: all)?) cookies\b|\bcookie (?:policy|settings|notice|preferences)\b|\bsubscribe (?:to|now|here|today)\b"
    r"|\bsign up (?:for|to|now|here)\b|\b(?:sign|log) ?in (?:to|now|here)\b|privacy policy|terms of (?:use|service)",
    re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>(?:.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<rest2>[^>]*+)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-z][^>]*\Z",
    re.I | re.S,
)
_CLOSED_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in CLOSED}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "content", "page_content", "heading", "notice")


def labelled_pages(seed: int = 7, pages: int = 150) -> list[str]:
    """Small pages by rule, ``pages`` of each of four layouts; words of main text start with m, others with o."""
    rng = random.Random(seed)

    def text(kind: str, low: int, high: int, linked: float = 0.0) -> str:
        n = rng.randint(low, high)
        of = round(linked * n)
        words = [kind + "".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(n)]
        return " ".join((['<a href="x">' + " ".join(words[:of]) + "</a>"] if of else []) + words[of:])

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f"<li>{text('o', 1, 3, 1)}</li>" for _ in range(rng.randint(low, high))) + "</ul>"

    def named(*names: str) -> str:
        return f'<div class="{rng.choice(names)}">{text("o", 2, rng.choice((10, 90)), rng.choice((0, 0, 0.3)))}</div>'

    def maybe(share: float, of) -> str:
        return of() if rng.random() < share else ""

    out = []
    for layout in ("article", "main", "named", "bare"):
        for _ in range(pages):
            share = (0, 0, 0, 0.1, 0.4) if layout == "bare" else (0, 0, 0, 0.3, 1)
            least = 6 if layout == "bare" else 1
            body = [f"<h1>{text('m', 2, 12)}</h1>" if layout != "bare" or rng.random() < 0.7 else ""]
            for k in range(rng.choice((1, 1, 2, 3, 5, 8, 12))):
                body.append(f"<p>{text('m', least if k else 2 * least, rng.choice((14, 40, 120)), rng.choice(share))}</p>")
                body.append(maybe(0.2, lambda: f"<h2>{text('m', 1, 7)}</h2><p>{text('m', 2 * least, 60)}</p>"))
                if layout != "bare":
                    body.append(maybe(0.15, lambda: "<ul>" + "".join(f"<li>{text('m', 1, 12, rng.choice(share))}</li>" for _ in range(3)) + "</ul>"))
                    body.append(maybe(0.15, lambda: named("ad", "related-posts", "share", "sidebar", "newsletter")))
                else:
                    body.append(maybe(0.2, lambda: f"<p>{text('m', 1, 6)}</p><p>{text('m', 12, 60)}</p>"))
            body.append(maybe(0.3, lambda: named("comments", "userComments")))
            inner = "".join(body)
            slogan = lambda: rng.choice(("", "", f"<p>{text('o', 2, 9)}</p>", f"<div>{text('o', 1, 5)}</div><div>{text('o', 2, 8, 0.5)}</div>"))
            stray = lambda: maybe(0.4, lambda: f"<p>{text('o', 3, 60)}</p>")
            if layout == "article":
                inner = stray() + f"<article>{inner}</article>" + stray()
                if rng.random() < 0.4:
                    inner = f"<main>{stray()}{inner}{stray()}</main>"
            elif layout == "main":
                inner = stray() + f"<main>{inner}</main>" + stray()
            elif layout == "named":
                inner = stray() + f'<div class="{rng.choice(("content", "article-body", "post-content"))}">{inner}</div>' + stray()
            notice = lambda: rng.choice(("ocopy copyright oall", "we use cookies ohere", "subscribe now ohere", "&copy; 2024 oname"))
            top = rng.choice((f"<nav>{links(2, 8)}</nav>", links(2, 8), f"<header>{text('o', 1, 4, 1)}</header>", f"<div>{text('o', 1, 4, 1)}</div>{links(2, 6)}"))
            top = maybe(0.7, lambda: top)
            end = rng.choice((f"<footer>{text('o', 2, 12)}</footer>", named("footer", "site-footer"), f"<div>{notice()} {text('o', 1, 12, 0.3)}</div>", f"<p>{notice()}</p>{links(2, 5)}", links(2, 6), ""))
            out.append(f"<html><body>{maybe(0.3, lambda: f'<div>{notice()} {text('o', 2, 30)}</div>')}{slogan()}{top}{slogan()}{inner}{end}</body></html>")
    return out


@dataclass
class Node:
    share: float
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def predict(self, x) -> float:
        node = self
        while node.low is not None:
            node = node.low if x[node.feature] <= node.at else node.high
        return node.share


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 3) -> Node:
    """A decision tree by Gini impurity; cuts lie midway between neighbouring values, with ``least`` rows on each side."""
    node = Node(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(v))
        a, b = ones[:-1], ones[-1] - ones[:-1]
        cost = a * (1 - a / n) + b * (1 - b / (len(v) - n))
        cost[(v[1:] == v[:-1]) | (n < least) | (len(v) - n < least)] = np.inf
        k = int(np.argmin(cost)) if len(cost) else 0
        if len(cost) and np.isfinite(cost[k]) and (best is None or cost[k] < best[0] - 1e-9):
            best = cost[k], f, (v[k] + v[k + 1]) / 2
    if best is None:
        return node
    _, node.feature, node.at = best
    low = x[:, node.feature] <= node.at
    node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


@functools.lru_cache(maxsize=1)
def train() -> Node:
    """The tree grown on the blocks of the labelled pages."""
    found = []
    for page in labelled_pages():
        page_blocks = blocks(page)
        out = set_aside(page_blocks)
        found += [(f, b.text) for b, f, o in zip(page_blocks.blocks, features(page_blocks, out), out) if not o]
    x = np.array([f for f, _ in found], float)
    return grow(x, np.array([t[0] == "m" for _, t in found], float))


@dataclass
class Block:
    text: str
    words: int
    links: float
    content: int  # 2 in an article, 1 in a main element or named container
    strong: bool  # in something whose tag, role or state sets it aside
    named: int  # the innermost element whose name does, or -1
    form: int  # the innermost form, or -1
    article: int  # the outermost article, or -1
    nested: bool  # in an article inside an article
    heading: bool


@dataclass
class Page:
    blocks: list[Block]
    named: list[tuple[int, int]]  # of each named element: the one around it, and which anchors it holds (a sum of bits)
    excused: set[int]  # forms around the content
    anchor: int  # the bit of the best anchor that the page has


#: What marks the main element of a page, best first; an h1 does only in what holds most of the page's words.
MAIN, ARTICLE, NAMED, HEADLINE = 8, 4, 2, 1


def names_aside(value: str, content: int) -> tuple[bool, int]:
    """Whether a class or id names an element as something beside the main text, and what content it names."""
    tokens = [[x.lower() for x in _PARTS.findall(t)] for t in value.split()]
    tokens = [t for t in tokens if t and t[0] not in MODIFIERS and t[-1] not in STATES]
    inside = max((1 for t in tokens if not ARTICLE_WORDS.isdisjoint(t) and CONTAINER_WORDS.issuperset(t)), default=0)
    if any(len(t) == 1 and t[0] in CONTAINERS for t in tokens):
        return False, inside
    for t in tokens:
        own = [x for x in t if x in ASIDE_WORDS]
        if own and all(x in ASIDE_WORDS or x in NEUTRAL or x.isdigit() or len(x) == 1 for x in t):
            return True, 0
        if t[-1] in HEADER_WORDS and not content and ARTICLE_WORDS.isdisjoint(t):
            return True, 0
    return False, inside


def _says(rest: str, content: int) -> tuple[bool, bool, int]:
    """Of an element's attributes: whether they set it aside by role or hide it, whether by name, and what content it is."""
    named, inside = False, 0
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, False, 0
        if name == "role":
            if value.lower() in ROLES and not (value.lower() == "banner" and content):
                return True, False, 0
            inside = max(inside, {"article": 2, "main": 1}.get(value.lower(), 0))
        if name in ("class", "id"):
            aside, more = names_aside(value, content)
            named, inside = named or aside, max(inside, more)
    return False, named, inside


class _Open:
    """The elements that are open: what holds for a block within them is kept with each, so nothing is searched."""

    def __init__(self):
        self.stack: list[tuple] = []  # name, and the state within: content, strong, named, form, article, nested
        self.places: dict[str, list[int]] = {}

    @property
    def state(self) -> tuple:
        return self.stack[-1][1] if self.stack else (0, False, -1, -1, -1, False)

    def push(self, name: str, state: tuple) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, state))

    def last(self, name: str) -> int:
        at = self.places.get(name)
        return at[-1] if at else -1

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()


def blocks(page: str) -> Page:
    """All text blocks of a page, in order."""
    out: list[Block] = []
    opened = _Open()
    named: list[list[int]] = []
    forms, forms_open, excused = 0, [], set()
    articles = 0
    anchors = 0
    no_end: set[str] = set()
    text: list[str] = []
    linked: list[str] = []
    state = opened.state
    in_link = 0
    heading = ""

    def close() -> None:
        nonlocal text, linked
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                n_linked = len(html.unescape("".join(linked)).split()) if linked else 0
                out.append(Block(" ".join(words), len(words), min(1.0, n_linked / len(words)), *state, bool(heading)))
            text, linked = [], []

    def anchor(bit: int) -> None:
        """Tells what is open that it holds the first such element."""
        nonlocal anchors
        if anchors & bit:
            return
        anchors |= bit
        k = opened.state[2]
        while k >= 0:
            named[k][1] |= bit
            k = named[k][0]

    at = 0
    scan = _TOKEN.finditer
    tokens = scan(page)
    while (m := next(tokens, None)) is not None:
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked.append(piece)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if m["raw"] is not None:
            if m["raw"].lower() == "title":
                close()
            continue
        if tag is None:
            continue
        tag = tag.lower()
        end = bool(m["end"] or m["end2"])
        rest = m["rest"] if m["rest"] is not None else m["rest2"]
        if tag in _CLOSED_END and not end:
            text.append(" ")
            if not (rest or "").endswith("/") and tag not in no_end:
                close_at = _CLOSED_END[tag].search(page, at)
                if close_at is None:
                    no_end.add(tag)
                else:
                    at = close_at.end()
                    tokens = scan(page, at)
            continue
        if tag == "a":
            in_link = max(0, in_link - 1) if end else 1
            if not end:
                linked.append(" ")
            continue
        if tag in SPACE:
            text.append(" ")
            linked.append(" ") if linked else None
        if tag in BLOCK:
            close()
            heading = tag if not end and len(tag) == 2 and tag[0] == "h" and tag != "hr" else ""
        if tag in VOID or tag not in BLOCK and tag != "span":
            continue
        if not end:
            if tag in IMPLIED:
                own = max(opened.last("dt"), opened.last("dd")) if tag in ("dt", "dd") else opened.last(tag)
                barrier = len(opened.stack) - 2 if tag == "p" else max((opened.last(b) for b in IMPLIED[tag]), default=-1)
                if own >= 0 and own > barrier:
                    opened.cut(own)
            content, strong, name, form, article, nested = opened.state
            inside = {"article": 2, "main": 1}.get(tag, 0)
            strong = strong or tag in ASIDE or tag == "header" and not content
            by_name, of_main = False, tag == "main"
            if rest and tag not in ("html", "body"):
                said, by_name, more = _says(rest, content)
                strong, inside = strong or said, max(inside, more)
                of_main = of_main or more == 1 and "main" in rest.lower()
            if by_name and not strong:
                named.append([name, 0])
                name = len(named) - 1
            if tag == "form":
                form, forms = forms, forms + 1
                forms_open.append(form)
            if inside == 2 or tag == "article":
                nested = nested or article >= 0
                article, articles = (articles if article < 0 else article), articles + 1
            opened.push(tag, (max(content, inside), strong, name, form, article, nested))
            if not strong and not nested:
                if inside and not by_name or tag == "article":
                    excused.update(forms_open)  # a form around the content doesn't set it aside
                    forms_open.clear()
                    anchor(MAIN if of_main and tag == "main" else ARTICLE if inside == 2 else NAMED)
                elif tag == "h1":
                    anchor(HEADLINE)
        else:
            k = opened.last(tag)
            if k >= 0:
                opened.cut(k)
                if tag == "form" and forms_open:
                    forms_open.pop()
        now = opened.state
        if now != state:
            close()
            state = now
    if at < len(page):
        text.append(page[at:])
    close()
    return Page(out, [tuple(x) for x in named], excused, anchors)


def set_aside(page: Page, names: bool = True, forms: bool = True) -> list[bool]:
    """Which blocks don't count because of the elements that they stand in."""
    most = [0] * len(page.named)
    for b in page.blocks:
        if b.named >= 0 and not b.strong:
            most[b.named] += b.words
    for k in range(len(most) - 1, -1, -1):  # what lies in an element lies in those around it
        if page.named[k][0] >= 0:
            most[page.named[k][0]] += most[k]
    total = sum(b.words for b in page.blocks if not b.strong)
    best = next((bit for bit in (MAIN, ARTICLE, NAMED, HEADLINE) if page.anchor & bit), 0)
    hides = []
    for k, (around, held) in enumerate(page.named):
        holds_main = bool(held & best) and (best != HEADLINE or 2 * most[k] >= total)
        hides.append(names and (not holds_main or around >= 0 and hides[around]))
    whole = forms and all(b.strong or b.form >= 0 and b.form not in page.excused for b in page.blocks)  # a page within one form
    by_article: dict[int, int] = {}
    linked: dict[int, bool] = {}
    out = []
    for b in page.blocks:
        aside = b.strong or b.nested or b.named >= 0 and hides[b.named] or forms and not whole and b.form >= 0 and b.form not in page.excused
        out.append(aside)
        if b.article >= 0 and not aside:
            by_article[b.article] = by_article.get(b.article, 0) + b.words
            linked[b.article] = linked.get(b.article, False) or b.heading and b.links > 0.5
    if len(by_article) > 1:
        largest = max(by_article.values())
        teasers = {a for a, n in by_article.items() if 4 * n < largest and (n <= 60 or linked[a])}
        out = [o or b.article in teasers for b, o in zip(page.blocks, out)]
    return out


def features(page: Page, aside: list[bool]) -> list[tuple]:
    """What the tree looks at in each block, in the order of ``FEATURES``."""
    found = page.blocks
    most = max((b.content for b, x in zip(found, aside) if not x), default=0)
    out = []
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None
        near = [x for n in (before, after) for x in ((n.words, n.links) if n else (0, 0.0))]
        out.append((b.words, b.links, *near, b.content, most, b.heading, bool(NOTICE.search(b.text))))
    return out


def main_text(page: str | None, tree: Node) -> tuple[str, int, int]:
    """The main text, how many blocks it has and how many the page has."""
    if not page:
        return "", 0, 0
    found = blocks(page)
    keep: list[str] = []
    for names, forms in ((True, True), (False, True), (False, False)):  # where nothing is left, the weakest reasons go
        aside = set_aside(found, names, forms)
        keep = [b.text for b, x, o in zip(found.blocks, features(found, aside), aside) if not o and tree.predict(x) >= 0.5]
        if not keep:
            keep = [b.text for b, o in zip(found.blocks, aside) if not o and b.links < 0.5 and not NOTICE.search(b.text)]
        if keep:
            break
    return "\n\n".join(keep), len(keep), len(found.blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", col: str = "html") -> DataFrame:
    """id, url, text, n_chars, n_blocks (of the text) and blocks_seen (of the page) of every page."""
    tree = train()
    names = [id_col, url, "text", "n_chars", "n_blocks", "blocks_seen"]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = [main_text(p, tree) for p in part.column(2).to_pylist()]
                texts, kept, seen = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.int64()), pa.array(seen, pa.int64())], names
                )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url)]
    return pages.select(id_col, url, col).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long, n_blocks long, blocks_seen long")
