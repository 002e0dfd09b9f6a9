import pytest

from quillon.llm.html_extract import extracted, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy now</div>
<article><h1>A title</h1><p><b>First&nbsp;&amp;  second<br>line<p>Next &lt;b&gt; one</p><p>Yes.</p><aside>See also</aside><form><p>Mail</p></form></article>
<section id="comments"><p>I agree with all of this and so does the other one</p></section><div class="cookie-notice">We use cookies</div><footer>&copy; all</footer></body>"""


def test_article():
    assert main_text(PAGE) == "A title\nFirst & second line\nNext <b> one\nYes."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "<nav><a>Menu</a></nav>", "<div class='footer'></div>"])
def test_nothing_to_extract_or_broken(page):
    assert main_text(page).strip("<p ") == ""


def test_pages_without_an_article():
    long = "This is the text of the page and it is about the things that are in it, as you would have it. " * 3
    page = f"<ul><li><a href='/'>Home</a></li><li><a href='/b'>About us</a></li></ul><h2>Head</h2><p>{long}</p><p>Short one.</p><p>{long}</p><div><a href='/x'>{'link text ' * 20}</a></div>"
    assert main_text(page).split("\n") == ["Head", long.strip(), "Short one.", long.strip()]


def test_hidden_and_quoted():
    assert main_text('<article><p>a</p><p hidden>b</p><div style="display: none"><p>c</p></div><p title="x > y">d</p><p>1 < 2</p></article>') == "a\nd\n1 < 2"
    assert main_text("just text") == "just text"


LONG = "This is the text of the page and it is about the things that are in it, as you would have it. " * 3
BODY = LONG.strip()


@pytest.mark.parametrize(
    "head, tail",
    [
        ('<div class="layout has-sidebar"><article>', "</article></div>"),
        ('<article class="post share-enabled">', "</article>"),
        ('<article class="post comments-open with-related">', "</article>"),
        ('<div class="no-sidebar content"><div class="long-form" id="search-guide">', "</div></div>"),
        ('<main class="has-sidebar"><div class="notice-of-motion">', "</div></main>"),
        ('<article><p class="form">Form</p><div class="share">', "</div></article>"),
        ('<form id="aspnetForm"><main>', "</main></form>"),
        ('<form>', "</form>"),
        ('<div class="content-sidebar-wrap"><article>', "</article></div>"),
        ('<div class="sidebar">', "</div>"),
    ],
)
def test_names_of_layout_lose_nothing(head, tail):
    page = f"<nav><a href=/>Home</a></nav>{head}<h1>Title</h1><p>{LONG}</p><p>Short.</p>{tail}<footer>About this and that and all of us</footer>"
    want = ["Form"] * (">Form<" in head) + ["Title", BODY, "Short."]
    assert main_text(page).split("\n") == want


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "cookie-notice", "commentList", "related-posts", "comments-area", "main-nav", "advert", "share-buttons", "newsletter signup"])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "{}"])
def test_names_of_boilerplate(name, wrap):
    page = wrap.format(f"<h1>Title</h1><p>{LONG}</p>") + f'<div class="x {name}"><p>{LONG} more</p><article><p>{LONG} teaser</p></article></div>'
    assert main_text(page).split("\n") == ["Title", BODY]


def test_teaser_in_article_and_body_outside():
    page = f"<article><p>A teaser of the thing.</p></article><div><h2>Head</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><p><a href=x>{LONG}</a></p>"
    assert main_text(page).split("\n")[-4:] == ["Head", BODY, "Yes.", BODY]


def test_boilerplate_within_an_article():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(4))
    page = f'<article><ul>{links}</ul><p>{LONG}</p><p><a href=/r>The report</a></p><p>Zwölf Boxkämpfer</p><div><a href=x>{"other things to read " * 9}</a></div><div class="comments"><p>{LONG}</p></div></article><p>Unnamed and short notice</p>'
    assert main_text(page).split("\n") == [BODY, "The report", "Zwölf Boxkämpfer"]


def test_article_of_short_blocks_stays_whole():
    assert main_text("<nav><a>x</a></nav><article><h1>Qwx</h1><p>Zzyx.</p><p>Brr</p></article><footer>f</footer>") == "Qwx\nZzyx.\nBrr"


@pytest.mark.parametrize(
    "page",
    ["<a" * 100_000, "<!" * 100_000, "<a b='" * 50_000 + ">", '<a "' * 100_000, "<svg>" * 50_000, "<div>" * 50_000 + "</p></section>" * 20_000 + "</div>" * 50_000, "<!--" * 50_000, "</" * 100_000 + ">", "<p =" * 50_000, "<a " + " " * 200_000, "<x y=\"z" * 50_000, "<p class=" * 50_000 + ">"],
)
def test_odd_markup_takes_linear_time(page):
    import time

    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 1


def test_quotes_that_are_no_values():
    assert main_text("<article><p class=it's>one</p><p data-x=\"a>b\" title='>'>two</p><p title=\"x>three</p></article>") == "one\ntwo\nthree"


def test_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (None, "v", "", 1)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.url, r.n_chars) for r in extracted(pages).collect())
    assert [g[2] for g in got] == [0, 45, 45, 0] or sorted(g[2] for g in got) == [0, 0, len(main_text(PAGE)), len(main_text(PAGE))]
    assert extracted(pages.limit(0)).count() == 0


def test_test_pages(spark, sf_dir):
    import html
    import re

    for row in extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|div)[^>]*>", inner)]
        assert row.text == "\n".join(b for b in blocks if b)
