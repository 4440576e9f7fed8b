import html
import re

import pytest

from guestlens.llm import article, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside><p>Side</p></aside><!-- <p>hidden</p> -->
<article class="post"><header class="entry-header"><h1>Head&amp;line &lt;b&gt;</h1></header>
<p>First  <b>para</b>
graph&nbsp;here.<br>Same block.</p><p>Short.<div class="ad">Buy now</div><figure><figcaption>A caption</figcaption></figure>
<form><label>Mail</label><input value="x"></form><ul><li>item one<li>item two</ul><blockquote>Quoted</blockquote>
<section id="comments"><p>Reader says</p></section></article>
<footer>&copy; Site</footer></body></html>"""


def test_article_without_what_is_around_it():
    assert article.main_text(PAGE).split("\n\n") == [
        "Head&line <b>", "First para graph here. Same block.", "Short.", "A caption", "item one", "item two", "Quoted"
    ]


def test_page_without_article_mark():
    menu = "<div><a href=/1>Home</a> <a href=/2>News</a></div>" * 6
    body = "".join(f"<p>Sentence number {i} of a text that is long enough.</p>" for i in range(12))
    got = article.main_text(f"<body>{menu}<div>{body}</div>{menu}<p>Tail</p></body>").split("\n\n")
    assert got == [f"Sentence number {i} of a text that is long enough." for i in range(12)]


PROSE = [f"Paragraph {i} of a text goes on for a while, so that it is prose and nothing else." for i in range(40)]
LINKS = "".join(f"<p><a href=/{i}>Some other headline of the site, number {i}</a></p>" for i in range(5))


def _paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_windows_decide_on_marked_pages():
    page = f"<body><p>Tagline</p><article>{_paragraphs(PROSE[:4])}{LINKS}{_paragraphs(PROSE[4:8])}</article>"
    assert article.main_text(page).split("\n\n") == PROSE[:8]  # menu in the article
    page = f"<body><main><h1>Head</h1>{_paragraphs(PROSE[:3])}</main><div>{_paragraphs(PROSE[3:9])}</div><p>Imprint</p>"
    assert article.main_text(page).split("\n\n") == ["Head", *PROSE[:3], *PROSE[3:9], "Imprint"]  # text outside the mark
    shares = "".join(f"<p><a href=/{i}>Share {i}</a></p>" for i in range(2))
    page = f"<article><h1>Head</h1><div class=share>{shares * 3}</div>{_paragraphs(PROSE[:2])}{shares}{_paragraphs(PROSE[2:3])}</article>"
    assert article.main_text(page).split("\n\n") == ["Head", *PROSE[:2], "Share 0", "Share 1", PROSE[2]]
    page = f"<article><h1>Head</h1>{LINKS}{_paragraphs(PROSE[:2])}<p><a href=/>Source</a></p></article>"
    assert article.main_text(page).split("\n\n") == ["Head", *PROSE[:2], "Source"]
    assert article.main_text(f"<article>{LINKS}</article>").count("\n\n") == 4


def test_unmarked_article_split_by_adverts():
    # a conclusion far shorter than the longest stretch, and citations that are mostly links
    cited = "As Smith wrote: <a href=/s>the long title of a paper on many things and some others</a>"
    advert = "<div class=ad>Buy</div>" * 4
    for between in (LINKS, advert, advert + LINKS):
        page = f"<body>{LINKS}<div>{_paragraphs([*PROSE[:30], cited, *PROSE[30:32]])}{between}{_paragraphs(PROSE[32:34])}</div>{LINKS}"
        got = article.main_text(page).split("\n\n")
        assert got == [*PROSE[:30], re.sub("<[^>]*>", "", cited), *PROSE[30:34]]
    page = f"<body>{_paragraphs(PROSE[:2])}{LINKS}{_paragraphs(PROSE[2:3])}{LINKS}{_paragraphs(PROSE[3:])}"
    assert article.main_text(page).split("\n\n") == PROSE


@pytest.mark.parametrize(
    "start", ["div class='content-sidebar-wrap'", "div class='layout has-sidebar'", "div id='no-comments'", "form id='aspnetForm'",
              "div class='sidebar'", "section class='main-menu'"]
)
def test_wrappers_of_the_whole_page(start):
    end, nav = f"</{start.split()[0]}>", "<nav><p>Menu of this page, which is long enough to be text</p></nav>"
    comments = f"<div class='post-comments'><article>{_paragraphs(PROSE[10:])}</article></div>"
    for body in (_paragraphs(PROSE[:9]), f"<article>{_paragraphs(PROSE[:9])}</article>", f"<main>{_paragraphs(PROSE[:9])}</main>"):
        page = f"<body><{start}>{nav}{body}{comments}{end}<form><p>A form that is long enough to be a text on its own</p></form>"
        assert article.main_text(page).split("\n\n") == PROSE[:9]


def test_nothing_of_the_article_is_lost():
    titles = ["search", "login", "sharing", "comments", "related", "alert", "notice", "share", "menu", "navigation", "sponsor"]
    body = "".join(f"<section id='{t.removesuffix('s')}'><h2 id='{t}'>About {t}</h2><p>Text of this part on {t}.</p></section>" for t in titles)
    expected = [x for t in titles for x in (f"About {t}", f"Text of this part on {t}.")]
    assert article.main_text(f"<article>{body}</article>").split("\n\n") == expected
    cited = [f"Author {i}, a paper with a title that is long enough to be no menu, volume {i}" for i in range(5)]
    references = "<ol>" + "".join(f"<li><a href=/{i}>{c}</a></li>" for i, c in enumerate(cited)) + "</ol>"
    for page in (f"{_paragraphs(PROSE[:2])}{references}", f"{_paragraphs(PROSE[:2])}{references}{_paragraphs(PROSE[2:4])}"):
        assert article.main_text(f"<article>{page}</article>").split("\n\n")[:7] == [*PROSE[:2], *cited]
    more = "<p class=notice>Take notice of this.</p><label>A label</label><blockquote><p>Said so.</p><footer>Somebody</footer></blockquote>"
    assert article.main_text(f"<article>{_paragraphs(PROSE[:1])}{more}<p class=ad>Buy</p><footer>Posted by</footer></article>").split("\n\n") == [
        PROSE[0], "Take notice of this.", "A label", "Said so.", "Somebody"
    ]


@pytest.mark.parametrize("unclosed", ["<nav><ul><li><a href=/>Home</a>", "<div class=ad>Buy now", "<header><p>Site", "<div class='cookie-notice'>We use cookies"])
def test_unclosed_elements_before_the_article(unclosed):
    for mark in ("article", "main"):
        page = f"<body>{unclosed}<{mark}>{_paragraphs(PROSE[:3])}</{mark}>"
        assert article.main_text(page).split("\n\n") == PROSE[:3]


def test_windows_decide_on_the_given_pages(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    gone = {"nav": 0, "footer": 0, "ad": 0}
    for page in pages:
        found = article.main_text(page, words=False)
        assert set(article.main_text(page).split("\n\n")) <= set(found.split("\n\n"))  # nothing of the article
        lines = found.split("\n\n")
        for name, pattern in (("nav", "<nav>(.*?)</nav>"), ("footer", "<footer>(.*?)</footer>"), ("ad", '<div class="ad">(.*?)</div>')):
            parts = [html.unescape(re.sub("<[^>]*>", "", x)) for x in re.split("</?li>", re.search(pattern, page, re.S)[1])]
            gone[name] += all(" ".join(p.split()) not in lines for p in parts if p.split())
    assert all(n >= 0.95 * len(pages) for n in gone.values())


@pytest.mark.parametrize("broken", [None, "", "<", "<p", "plain text", "</p></div>", "<article>", "<a b='", "&#xZZ;&bogus;", "<![CDATA["])
def test_odd_pages(broken):
    got = article.main_text(broken)
    assert got == ("plain text" if broken == "plain text" else got)


def test_long_page_and_deep_nesting():
    page = "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>word word</p>" * 20_000 + "</article>"
    assert article.main_text(page).count("\n\n") == 20_000


def test_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "v", "", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = sorted((str(r.page_id), r.url, len(r.text)) for r in article.extract_articles(frame).collect() if r.url)
    assert got == [("1", "u", len(article.main_text(PAGE)))] * 2 + [("2", "v", 0)]
    assert article.extract_articles(frame).count() == 4 and article.extract_articles(frame.where("false")).count() == 0


def test_query_against_the_given_markup(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op6_extract_articles(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (html.unescape(re.sub("<[^>]*>", " ", b)) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
        assert r.text == "\n\n".join(" ".join(b.split()) for b in blocks if b.split()) and r.n_chars == len(r.text)
