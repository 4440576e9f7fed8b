import pytest
from pyspark.sql import functions as F

from guestlens.functions import markup, page_texts
from guestlens.operators import workplan
from guestlens.plans import ingest

REVIEWS = """
<div data-testid="review" class="c-review-block">
    <h3 class="c-review-block__title" data-testid="review-title">Room with a view</h3>
    <span class="bui-review-score__badge" data-testid="review-score">7.8</span>
    <p data-testid="review-date">Reviewed: 3 March 2024</p>
    <div data-testid="review-positive-text">Quiet courtyard<br>and warm bread &amp; <i>jam</i>.</div>
    <div data-testid="review-negative-text"><div>The lift</div><div>was   slow.</div></div>
</div>
<div data-testid="review" class="c-review-block">
    <b class="c-review-block__title">Demasiado lejos</b>
    <div class="x bui-review-score__badge">6,5</div>
    <div class="c-review-block__date">Comentó el: 7 de mayo de 2022</div>
    <div class="c-review-block__row">El autobús tarda una hora.</div>
</div>
"""


def pages_of(spark, *html):
    rows = [(i, f"http://h.example/{i}", i, "H", h) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, page_no long, hotel_name string, html string")


def test_review_records(spark):
    got = ingest.review_records(pages_of(spark, REVIEWS)).orderBy("pos").collect()
    first, second = got
    assert first.title == "Room with a view" and first.score == "7.8"
    assert first.positive == "Quiet courtyard\nand warm bread & jam."
    assert first.negative == "The lift\nwas slow."
    assert first.date == "Reviewed: 3 March 2024"
    assert (second.title, second.score, second.negative) == ("Demasiado lejos", "6.5", "")
    assert second.positive == "El autobús tarda una hora."
    assert second.hotel_url == "http://h.example/0"


def test_equal_records_of_a_page_count_once(spark):
    assert ingest.review_records(pages_of(spark, REVIEWS + REVIEWS, REVIEWS)).count() == 4


def test_records_are_compared_when_finished(spark):
    block = """<li class="review_item"><b data-testid="review-title">T</b><i data-testid="review-score">%s</i>
      <p data-testid="review-positive-text">P</p>%s</li>"""
    row = '<div class="c-review-block__row">unused</div>'
    page = block % ("Score: 9", "") + block % ("9", "") + block % ("9", row) + block % ("8", "")
    got = ingest.review_records(pages_of(spark, page)).orderBy("pos").collect()
    assert [(r.pos, r.title, r.score, r.positive) for r in got] == [(0, "T", "9", "P"), (1, "T", "8", "P")]


def test_a_failing_block_drops_only_itself(monkeypatch):
    read = page_texts._Element.text

    def text(element):
        if "bad" in "".join(element.parts):
            raise ValueError("bad block")
        return read(element)

    monkeypatch.setattr(page_texts._Element, "text", text)
    block = '<li class="review_item"><b data-testid="review-title">%s</b></li>'
    records, errors = page_texts.review_records(block % "one" + block % "bad" + block % "two")
    assert [r["title"] for r in records] == ["one", "two"] and errors == ["ValueError: bad block"]


def test_unclosed_list_items_and_scripts():
    html = """<ul><li class="review_item"><p class="c-review__body--positive">One<p>more
      <li class="review_item"><span class="c-review__body--negative">Two<script>var x = "</b>";</script></span>
      <!-- <li class="review_item"> --></ul>"""
    got, _ = page_texts.review_records(html)
    assert [(r["positive"], r["negative"]) for r in got] == [("One", ""), ("", "Two")]


def test_nested_items_each_give_a_record():
    html = '<li class="review_item"><div class="c-review-block"><h3 data-testid="review-title">T</h3></div></li>'
    assert [r["title"] for r in page_texts.review_records(html)[0]] == ["T", "T"]


def test_broken_markup_never_raises():
    for html in ["", "<", "<div", "</div></p>", "<a b='", "<![CDATA[", "<li class=review_item><p", "&#xZZ;&bogus;"]:
        page_texts.review_records(html)
        page_texts.head_texts(html)
        page_texts.hotel_hrefs(html)


def test_rejects(spark):
    pages = pages_of(spark, REVIEWS, "", None, "<p>nothing</p>", '<div class="c-review-block"></div>')
    got = {r.page_id: r.reason for r in ingest.rejects(pages).collect()}
    assert got == {1: "empty_page", 2: "empty_page", 3: "no_reviews"}


def names(spark, *html, marker="Site.example"):
    frame = ingest.with_hotel_name(pages_of(spark, *html), marker)
    return [r.hotel_name for r in frame.orderBy("page_id").collect()]


LD = '<script type="application/ld+json">%s</script>'


def test_hotel_names(spark):
    cases = {
        LD % '{"@type":"Hotel","name":"A"}': "A",
        LD % '[{"@type":"X","name":"no"},{"@type":"Hostel","name":""},{"@type":"LodgingBusiness","name":"B"}]': "B",
        LD % '{"@type":["Hotel"],"name":"no"}' + "<title>C</title>": "C",
        LD % '{"@type":"Resort","name":"no"}' + "<title>D</title>": "D",  # no script word in it
        LD % '{"@type":"Hotel"' + LD % '{"@type":"Hotel","name":"no"}' + "<title>E</title>": "E",
        LD % '{"@type":"Hotel","name":"F"}' + LD % "{Hotel": "F",
        LD % '{broken without the word' + LD % '{"@type":"Hotel","name":"G"}': "G",
        '<meta property="og:title" content="H &amp; H, City">': "H & H",
        '<meta content=" I > J , x" property="og:title">': "I > J",
        '<meta property="og:title" content=",x"><h2 id="hp_hotel_name">no</h2>': "",
        '<meta property="og:title" content=""><h2 id="hp_hotel_name"> K <i>k</i></h2>': "K k",
        '<h2 id="hp_hotel_name"> </h2><div class="hp__hotel-name">no</div><h2 class="a pp-header__title">L</h2>': "L",
        '<h2 data-testid="post-booking-header-title">M</h2>': "M",
        '<div class="hp__hotel-name"><div>N</div></div>': "N",
        "<title>Casa Azul - Site.example</title>": "Casa Azul",
        "<title> Updated Prices  O -- \n Site.example - x</title>": "O",
        "<p>nothing</p>": "",
    }
    assert names(spark, *cases) == list(cases.values())


def test_one_walk_gives_records_and_rejects(spark):
    pages = pages_of(spark, REVIEWS, "", "<p>none</p>")
    records, rejected = ingest.records_and_rejects(pages)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(records) == rows(ingest.review_records(pages)) and rows(rejected) == rows(ingest.rejects(pages))
    assert records.count() == 2 and rejected.count() == 2
    for frame in (records, rejected):  # the review elements are not walked again
        assert "review_blocks" not in frame._jdf.queryExecution().executedPlan().toString()


def test_links_are_read_once(spark):
    plan = workplan.harvest_hotel_links(pages_of(spark, "<p>"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_title_without_marker(spark):
    assert names(spark, "<title>P - Site.example</title>", marker=None) == ["P - Site.example"]


def test_expected_count(spark):
    cases = {
        '<a data-testid="review-score-link"><div>8,5</div><div>Opiniones (2,045)</div></a>': 2045,
        '<a class="js-review-tab-link">x</a><b data-tab-target="htReviews">(12)</b>': 12,
        '<a class="js-review-tab-link">(1,234,567)</a><i class="d8eab2cf7f">1.234 reviews</i>': 1234,
        '<i class="bui-review-score__text">4.5</i>': 45,
        '<i class="bui-review-score__text">none</i>': 0,
        "<p>(99)</p>": 0,
    }
    headed = pages_of(spark, *cases).select("page_id", markup.head_texts(F.col("html")).alias("head"))
    got = headed.select("page_id", markup.expected_count(F.col("head"))).orderBy("page_id").collect()
    assert [r[1] for r in got] == list(cases.values())


def test_hotel_links(spark):
    html = """<a data-testid="title-link" href="/b">1</a><a class="q e3859ef1a4" href="/a">2</a>
      <div class="c-property-card__title"><p><a href="c?x=1">3</a></p></div><a href="/no">4</a>
      <a data-testid="title-link" href="">5</a><a data-testid="title-link">6</a><a data-testid="title-link" href="/b">7</a>"""
    got = workplan.harvest_hotel_links(pages_of(spark, html, html)).orderBy(*workplan.LINK_ORDER).collect()
    by_url = [r.url for r in got]
    assert by_url == ["http://h.example/b", "http://h.example/a", "http://h.example/c?x=1"]
    assert [(r.first_page, r.first_place) for r in got] == [(0, 0), (0, 1), (0, 2)]


@pytest.mark.parametrize(
    "href, expected",
    [
        ("/x", "http://h.example/x"), ("y", "http://h.example/d/y"), ("?q=2", "http://h.example/d/p?q=2"),
        ("#f", "http://h.example/d/p?q=1#f"), ("//o.example/z", "http://o.example/z"), ("mailto:a@b", "mailto:a@b"),
        ("https://o.example", "https://o.example"), ("../x/./y/../z", "http://h.example/x/z"), ("..", "http://h.example/"),
        ("/a/../../b?q=/../c", "http://h.example/b?q=/../c"), ("/a/b/..", "http://h.example/a/"), ("/a..b", "http://h.example/a..b"),
    ],
)
def test_resolve_href(spark, href, expected):
    frame = spark.createDataFrame([(href, "http://h.example/d/p?q=1#top")], "h string, u string")
    assert frame.select(markup.resolve_href(F.col("h"), F.col("u"))).first()[0] == expected


def test_anchor_pattern(spark):
    html = """<a class="k" title="a > b" href='/1'>x</a><A HREF=/2 class="k">y</A><abbr href="/no"></abbr><a href="/3">"""
    frame = pages_of(spark, html)
    assert frame.select(markup.anchor_hrefs(F.col("html"))).first()[0] == ["/1", "/2", "/3"]
    odd = pages_of(spark, """<a title=it's href="/two">x</a> <a data-x=" href='/no' " href=/3>y</a><a href="/4?a&amp;b">z</a>""")
    got = sorted((r.first_place, r.url) for r in workplan.harvest_anchors(odd).collect())
    assert [url for _, url in got] == ["http://h.example/two", "http://h.example/3", "http://h.example/4?a&b"]
    assert frame.select(markup.anchor_hrefs(F.col("html"), 'class="k"')).first()[0] == ["/1", "/2"]
