"""Main text of generated page templates against the known article."""

import time
import itertools
import random

import pytest

from barloom.llm import html_text

WORDS = "the of and to in is that it was for on are as with his they at be this have from or one had by word but not what all".split()
WRAPPERS = [
    "{}", '<div class="no-sidebar">{}</div>', '<div class="layout with-sidebar">{}</div>', '<main class="has-social-share">{}</main>', '<div class="ad-free">{}</div>',
    '<form action="/x" method="post">{}</form>', '<div class="elementor-widget-wrap">{}</div>', '<form id="aspnetForm"><div class="page-sidebar-left">{}</div></form>',
    '<div id="page"><div class="overflow-hidden">{}</div></div>', '<div class="site-menu-open"><div class="row"><div class="col-8">{}</div></div></div>',
]
ARTICLES = ["<article>{}</article>", '<article class="post tags-science comments-open">{}</article>', '<div class="content">{}</div>', '<div itemprop="articleBody">{}</div>', "<main>{}</main>"]
BEFORE = [
    '<header class="site"><p>The Daily Name</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, today</a></li></ul></nav>',
    '<div role="banner">Name of it</div><div class="main-menu"><a href="/">One</a> <a href="/">Two</a></div><div class="cookie-notice"><p>We use cookies, for you. Accept them, please.</p></div>',
    '<nav class="navbar"><a>x</a></nav><div class="ad">Buy this now, it is good. Or that.</div>',
]
AFTER = [
    '<aside><h2>More</h2><p>Something else, to read. And more.</p></aside><footer>&copy; 2024 Name. All rights, reserved.</footer>',
    '<section id="comments"><p>{long}</p><p>I agree, with that. Well said.</p></section><form><label>Name</label><input name="q"><textarea>Text</textarea><button>Send</button></form><footer>f</footer>',
    '<div class="sidebar"><h3>Popular</h3><p>Read this, now. It is new.</p></div><div class="newsletter-signup"><p>Get our letter, weekly.</p></div><div class="share-buttons"><a>a</a></div><script>var x = "<p>no</p>";</script>',
]


def sentence(rng, n):
    words = rng.choices(WORDS, k=n)
    return " ".join(w + ("," if i % 6 == 5 else "") for i, w in enumerate(words)).strip(",").capitalize() + "."


def article(rng):
    title = sentence(rng, 5)
    paragraphs = [" ".join(sentence(rng, rng.randrange(6, 18)) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(3, 9))]
    paragraphs.insert(2, "Short.")
    markup = [f"<h1>{title}</h1>", *(f"<p>{p.replace('of', '<em>of</em>', 1)}</p>" for p in paragraphs), "<ul><li>first point<li>second &amp; last</ul>"]
    return "\n".join([title, *paragraphs, "first point", "second & last"]), "\n".join(markup)


CASES = list(itertools.product(WRAPPERS, ARTICLES, BEFORE, AFTER))


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_templates(wrapper):
    rng = random.Random(6)
    for _, kind, before, after in (c for c in CASES if c[0] == wrapper):
        want, markup = article(rng)
        long = " ".join(sentence(rng, 12) for _ in range(40))
        inside, page = wrapper.format(kind.format(markup)), "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class='sidebar-open'>{}{}{}</body></html>"
        assert html_text.main_text(page.format(before, inside, after.replace("{long}", long))) == want


def test_furniture_inside_of_the_article():
    page = (
        "<article><header><h1>T</h1></header><div class='ad'><p>Buy it, now. It is good, and cheap.</p></div><p>Real text, here it is. More of it, too.</p>"
        "<div class='related-posts'><ul><li><a>Other</a></li></ul></div><p>Last real text, of the page.</p><div class='post-comments'><article class='comment'><p>So true, all of it. I agree.</p></article></div>"
        "<footer>By me</footer></article>"
    )
    assert html_text.main_text(page) == "T\nReal text, here it is. More of it, too.\nLast real text, of the page."


def test_nothing_but_furniture():
    assert html_text.main_text("<nav><h1>Site</h1>menu</nav><div class='ad'>Buy, this.</div><article></article><footer>f</footer>") == ""


@pytest.mark.parametrize("depth", [3, 220, 520, 5000])
def test_depth_does_not_matter(depth):
    page = "<div>" * depth + "<nav>menu, of it</nav><div class='sidebar'>aside, here.</div><p>The text, is here.</p>"
    assert html_text.main_text(page) == "The text, is here."


def test_references_are_decoded_within_one_piece_of_text():
    assert html_text.main_text("<p>a &amp; b &<b>lt;</b> c &lt;d&gt; &#233;</p>") == "a & b &lt; c <d> é"


@pytest.mark.parametrize("n", range(1, 8))
def test_few_blocks(n):
    want = [f"Text {i}, of the page. It goes on." for i in range(n)]
    assert html_text.main_text("<nav>m</nav>" + "".join(f"<p>{t}</p>" for t in want)) == "\n".join(want)


def test_table(spark):
    long = "<article>" + "<p>Some words, of it.</p>" * 50_000 + "</article>"
    rows = [(1, "u", "<p>a b.</p>", 7), (1, "u", "<p>a b.</p>", 7), (None, None, None, None), (2, "v", "", 1), (3, "w", long, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, len(r.text)) for r in got.collect()) == [(0, 0), (1, 4), (1, 4), (2, 0), (3, 50_000 * 19 - 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<a" * 500_000, "<" + "x" * 1_000_000, '<a "' * 250_000, "<a '>" * 200_000, '<a">"' * 200_000, "<!--" * 250_000, "<![CDATA[" * 110_000, "</" * 500_000, "<a =" * 250_000 + ">", "<b class='" * 100_000],
    ids=["tags", "name", "quotes", "closed", "pairs", "comments", "sections", "slashes", "marks", "classes"],
)
def test_hostile_pages_end(page):
    """A megabyte of mark-up that never closes takes time in proportion to its length."""
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 8


def test_markup_that_does_not_close():
    def body(page):
        return html_text.main_text(f"<article><p>{'word ' * 30}.</p>{page}")

    plain = html_text.main_text(f"<article><p>{'word ' * 30}.</p></article>")
    assert body("<!-- never > closed") == plain and body("<!-- a --><!x y></article>") == plain
    assert body('<p title="a>b">more words, and more.</p></article>') == plain + "\nmore words, and more."
    assert body('<p title="a>more words, and more.</p></article>') == plain + "\nmore words, and more."
    assert body("<p>3 < 4, and a <b").endswith("3 < 4, and a <b")
