import pytest

from octaspark.llm import html

TREE = html.train()
LONG = "This paragraph is long enough to be told from menus and other short pieces of the page, it has quite a few words in it."

PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{x}}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice"><p>{LONG} We use cookies.</p></div><div class="ad">Buy this now.</div>
<article><h1>Head &amp; line</h1><p>First&nbsp;paragraph with <b>bold</b> and <a href="x">a link</a> in
it.<p>Short one.</p><aside class="sidebar">{LONG} Aside.</aside><p>{LONG}<br>More.</p>
<form><label>Mail</label><input name="m"><button>Send</button></form>
<section id="comments"><h2>Comments</h2><p>{LONG} says a reader.</p></section></article>
<footer>&copy; 2024 someone</footer></body></html>"""


def test_article():
    text, n, _ = html.main_text(PAGE, TREE)
    assert text == f"Head & line\n\nFirst paragraph with bold and a link in it.\n\nShort one.\n\n{LONG} More."
    assert n == 4


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<p>", "<!-- x", "<script>never ends", "&am", "<div><div></p></span>"])
def test_broken_pages(page):
    assert html.main_text(page, TREE)[0] in ("", "<", "&am")


def test_page_without_article():
    page = f'<body><div id="menu"><a href="/">Home</a></div><h1>Title of it</h1><p>{LONG}</p><p>{LONG} &lt;tag&gt;</p><div class="footer">Imprint</div></body>'
    assert html.main_text(page, TREE)[0] == f"Title of it\n\n{LONG}\n\n{LONG} <tag>"


def test_cut_off_page():
    assert html.main_text(f"<article><p>{LONG}</p><p>And the end &amp; so <b", TREE)[0] == f"{LONG}\n\nAnd the end & so"


NAV = '<ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li></ul>'


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><head><title>T</title><body>{NAV}<article><p>{LONG}</p></article>", LONG),  # </head> left out
        (f'<body><div id="content" class="with-sidebar"><article><p>{LONG}</p></article></div>', LONG),
        (f'<body><div id="content" class="with-sidebar"><h1>Title here</h1><p>{LONG}</p></div><div id="sidebar">{LONG}</div>', f"Title here\n\n{LONG}"),
        (f'<article><div class="article-header"><h1>Head line</h1></div><p>{LONG}</p></article>', f"Head line\n\n{LONG}"),
        (f"<body>{NAV}<p>{LONG}</p></body>", LONG),
        (f"<body>{NAV}<p>{LONG}</p><p>{LONG} Two.</p><footer>Imprint</footer></body>", f"{LONG}\n\n{LONG} Two."),
        (f'<article><p>{LONG}</p><p><a href="x">{LONG} Linked.</a></p><ul><li><a href="y">A linked item</a></li></ul></article>', f"{LONG}\n\n{LONG} Linked.\n\nA linked item"),
        (f'<article><p>{LONG}</p><div class="userComments"><p>{LONG} says a reader.</p></div></article>', LONG),
        (f'<form id="page"><div class="bar"><input name="q"></div><article><p>{LONG}</p></article></form>', LONG),
        (f"<form><h1>Title of it</h1><p>{LONG}</p><p>{LONG} Two.</p></form>", f"Title of it\n\n{LONG}\n\n{LONG} Two."),
        (f"<article><p>{LONG}</p><svg><p>{LONG} Two.</p></article>", f"{LONG}\n\n{LONG} Two."),  # an svg without an end
        (f'<article><ul><li class="ad">Buy<li>Kept item</ul><p>{LONG}</p></article>', f"Kept item\n\n{LONG}"),
        (f"<article><video-player>{LONG}</video-player></article>", LONG),
    ],
)
def test_pages_of_many_kinds(page, want):
    assert html.main_text(page, TREE)[0] == want


def test_text_known_by_construction():
    """Precision and recall over blocks of pages that the tree hasn't seen, by layout."""
    pages = html.labelled_pages(seed=99, pages=60)
    for k in range(4):
        kept = main = right = 0
        for page in pages[60 * k : 60 * k + 60]:
            found = html.blocks(page).blocks
            text = html.main_text(page, TREE)[0].split("\n\n")
            own = [b.text for b in found if b.text.startswith("m")]
            kept, main, right = kept + len(text), main + len(own), right + sum(t in own for t in text)
        assert right >= 0.97 * kept and right >= 0.97 * main, (k, kept, main, right)


def test_ties_and_long_pages(spark):
    long = f"<article><p>{LONG * 20_000}</p></article>"
    pages = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, "u", f"<article><p>{LONG}</p></article>")], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html.extract(pages).collect()) == [len(LONG), *[len(LONG * 20_000)] * 2]


def test_against_a_plain_reading(spark, sf):
    """The test tables' pages hold one article each; all its blocks, by a plain parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.skip, self.blocks = False, 0, [[]]

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside = True
            self.skip += tag in ("aside", "script", "style", "form") or "class" in dict(attrs) and tag == "div"
            if tag in ("p", "h1", "h2", "li", "article", "div"):
                self.blocks.append([])
            elif tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside = False
            if tag in ("aside", "script", "style", "form", "div"):
                self.skip = max(0, self.skip - 1)
            if tag in ("p", "h1", "h2", "li", "article", "div"):
                self.blocks.append([])

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.blocks[-1].append(data)

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        want = [" ".join("".join(b).split()) for b in plain.blocks]
        assert got[r.page_id] == "\n\n".join(b for b in want if b), r.page_id


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = html.extract(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    assert not any("<p>" in r.text or "&amp;" in r.text or "©" in r.text for r in rows)
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", PAGE, "x"), (2, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html.extract(odd).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and len(got) == 4
    assert html.extract(odd.limit(0)).count() == 0


STORY = "<h1>The headline of it</h1>" + "".join(f"<p>{LONG} {k}</p>" for k in range(5))
TOLD = "\n\n".join(["The headline of it", *(f"{LONG} {k}" for k in range(5))])


@pytest.mark.parametrize(
    "opening",
    [
        *(f'article class="{c}"' for c in ("post category-legal", "post tag-social-media", "hentry comments-open", "post format-aside", "post status-publish has-related", "entry share-enabled", "story topic-advertising", "post type-notice")),
        *(
            f'div class="{c}"'
            for c in ("wrapper sidebar-right", "layout right-sidebar", "site menu-open", "page no-sidebar", "container with-footer", "content nav-visible", "row sidebar-left", "app cookie-consent-active", "main widget-area", "grid promo-on", "search-results-article", "newsletter-archive-story")
        ),
        'div id="search-results-article"', 'div id="social-history"', 'main class="sidebar"', 'section class="notice-of-the-meeting"', 'div class="legal-news"', 'div class="comments"', 'div id="footer"',
    ],
)
def test_names_of_containers_keep_the_page(opening):
    page = f"<body>{NAV}<{opening}>{STORY}</{opening.split()[0]}><footer>Imprint</footer></body>"
    assert html.main_text(page, TREE)[0] == TOLD


@pytest.mark.parametrize(
    "aside",
    [
        *(f'<div class="{c}"><p>{LONG}</p></div>' for c in ("sidebar", "site-footer", "main-nav", "cookie-banner", "related-posts", "comment-list", "reader-opinions", "user-feedback", "adSlot", "sidebar-right", "newsletter-box", "share-buttons")),
        f'<div id="comments"><article><p>{LONG} says a reader.</p></article></div>', f"<article><h2><a href='x'>Another story</a></h2><p>{LONG[:60]}</p></article>", f"<aside><p>{LONG}</p></aside>",
        f'<div role="complementary"><p>{LONG}</p></div>', f"<p hidden>{LONG}</p>", f'<section class="discussion"><h2>Talk</h2><p>{LONG}</p><p>{LONG}</p></section>',
    ],
)
@pytest.mark.parametrize("inside", [False, True])
def test_what_stands_beside_goes(aside, inside):
    page = f"<body>{NAV}<article>{STORY}{aside if inside else ''}</article>{'' if inside else aside}</body>"
    assert html.main_text(page, TREE)[0] == TOLD


def test_words_of_notices_in_main_text():
    bake = "Bake the cookies for ten minutes and then let them cool on a rack."
    assert html.main_text(f"<h1>Cookies</h1><p>{bake}</p>", TREE)[0] == f"Cookies\n\n{bake}"
    assert html.main_text(f"<p>We use cookies on this site.</p><h1>Cookies</h1><p>{bake}</p><p>{LONG}</p><p>&copy; 2024 Baker</p>", TREE)[0] == f"Cookies\n\n{bake}\n\n{LONG}"


def test_the_tree_needs_words_links_and_neighbours():
    used = set()

    def walk(node):
        if node.low is not None:
            used.add(html.FEATURES[node.feature])
            walk(node.low)
            walk(node.high)

    walk(TREE)
    assert {"words", "links"} <= used and used & {"words_before", "words_after"} and used & {"links_before", "links_after"}
    line = "Six words stand in this line"  # main text between paragraphs, not between links
    between = html.main_text(f"<body>{NAV}<h1>Title of it</h1><p>{LONG}</p><p>{line}</p><p>{LONG}</p></body>", TREE)[0]
    beside = html.main_text(f'<body><p>{line}</p>{NAV}<h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p></body>', TREE)[0]
    assert line in between and line not in beside


@pytest.mark.parametrize("piece", ["<button>x", "<div>", "<div class='a'><li>", "<p title=\"x>", "<ul><li><p>", "<form><article>", "</div>", "<svg><p>", "<!--", "<span class='comments'>y", "<h1>z</h2>"])
def test_time_is_linear(piece):
    import time

    page = "<body>" + piece * (1_000_000 // len(piece))
    start = time.process_time()
    html.main_text(page, TREE)
    assert time.process_time() - start < 12  # a second or two on a quiet machine; quadratic parsing takes minutes
