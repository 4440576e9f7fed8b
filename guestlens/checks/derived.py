"""Review data derived from the given tables.

Reviews: a document is the text of a review, its source the hotel, the events that fall
to it the score and the date, its label decides whether the text is praise, complaint or
half of each. Every event falls to one document: its number modulo that of the documents.
A document without events has neither score nor date. Pages: review and hotel pages are built around those texts.
Nothing is sampled; every document and its whole text are used.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.functions.dates import ENGLISH_MONTHS, SPANISH_MONTHS
from guestlens.functions.scores import extract_score
from guestlens.operators.dedup import keep_first, with_hash
from guestlens.plans.analysis import enrich_reviews
from guestlens.sources.writers import stored_form

MIRROR_OFFSET = 10_000_000_000
SEQS_PER_PAGE = 600
SITE = "Stay.example"

# The invented prose has no real polar words, so some of its own words stand for them.
LEXICON = {
    "en": (["ing", "orre", "thatin", "hehely", "ble"], ["rewh", "ononst", "inoran", "tion", "wh"]),
    "es": (["ado", "mente", "ciónue", "ga"], ["ción", "rr", "ciónos", "ll"]),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _month_name(names: list[str], date: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(names)), " "), F.month(date))


def first_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """One raw review per document, plus the number of its events, whether a mirror has it
    (one click more than a multiple of three), whether it shows twice (the same of
    purchases), and the quality of its label."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    documents = docs.agg(F.max("doc_id") + 1).first()[0]
    events = table(spark, sf, "events")
    events = events.groupBy((F.col("event_id") % documents).alias("doc_id")).agg(
        F.min("ts").alias("ts"),
        F.max("value").alias("value"),
        F.count(F.lit(1)).alias("n_events"),
        (F.count_if(F.col("event_type") == "click") % 3 == 1).alias("mirrored"),
        (F.count_if(F.col("event_type") == "purchase") % 3 == 1).alias("twice"),
    )
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    # the narrow sides are hashed, so that no text is sorted
    base = docs.join(events.hint("shuffle_hash"), "doc_id", "left").join(labels.hint("shuffle_hash"), "doc_id", "left")

    n, text, v, quality = F.col("doc_id"), F.col("text"), F.col("value"), F.col("quality")
    no = F.lit(False)
    tenth = (F.floor(v * 10) % 10).cast("string")
    score = (
        F.when((n % 17 == 0) | v.isNull(), "No score")
        .when(n % 5 == 0, F.concat(F.floor(v / 50).cast("string"), F.lit(","), tenth))
        .otherwise(F.concat(F.lit("Score: "), F.floor(v).cast("string"), F.lit("."), tenth))
    )
    half = F.floor(F.length(text) / 2).cast("int")
    positive = F.when(quality == 0, "").when(quality == 1, text).otherwise(F.substring(text, F.lit(1), half))
    negative = (
        F.when((quality == 1) | ((quality == 0) & (n % 2 == 0)), "")
        .when(quality == 0, text)
        .otherwise(F.substring(text, half + 1, F.length(text)))
    )
    day = F.date_add(F.to_date("ts"), (n % 400).cast("int"))
    english = [m.capitalize() for m in ENGLISH_MONTHS]
    date = (
        F.when((n % 23 == 0) | day.isNull(), "sin fecha")
        .when(
            n % 2 == 0,
            F.concat_ws(" ", F.lit("Reviewed:"), F.day(day), _month_name(english, day), F.year(day)),
        )
        .otherwise(
            F.concat_ws(" ", F.lit("Comentó el:"), F.day(day), F.lit("de"), _month_name(SPANISH_MONTHS, day),
                        F.lit("de"), F.year(day))
        )
    )
    return base.select(
        n.alias("seq"),
        F.col("source").alias("hotel_name"),
        F.concat(F.lit("https://stay.example/"), F.col("source"), F.lit("/"), (n % 3).cast("string")).alias("hotel_url"),
        F.split_part(text, F.lit("."), F.lit(1)).alias("title"),
        score.alias("score"),
        positive.alias("positive"),
        negative.alias("negative"),
        date.alias("date"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"),
        F.coalesce("mirrored", no).alias("mirrored"),
        F.coalesce("twice", no).alias("twice"),
        "quality",
    )


HELPERS = ["n_events", "mirrored", "twice", "quality"]


def _mirrored(first: DataFrame, is_mirror: Column) -> DataFrame:
    """The rows as the mirror delivers them where `is_mirror`, unchanged elsewhere."""

    def change(column: str, changed: Column) -> Column:
        return F.when(is_mirror, changed).otherwise(F.col(column))

    return first.withColumns(
        {
            "seq": change("seq", F.col("seq") + MIRROR_OFFSET),
            "hotel_name": change("hotel_name", F.concat("hotel_name", F.lit(" (mirror)"))),
            "score": change("score", F.lit("Score: 5.0")),
            "n_events": change("n_events", F.lit(0)),
        }
    )


def second_delivery(first: DataFrame) -> DataFrame:
    """A mirror delivers some reviews once more under its own name."""
    return _mirrored(first.where("mirrored"), F.lit(True))


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Both deliveries, made from one pass over the tables."""
    sides = F.when(F.col("mirrored"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    both = first_delivery(spark, sf).withColumn("_mirror", F.explode(sides))
    return _mirrored(both, F.col("_mirror")).drop("_mirror")


def raw_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return deliveries(spark, sf).drop(*HELPERS)


def labelled_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The part already stored when a new batch arrives: first deliveries with a label."""
    first = first_delivery(spark, sf)
    return first.where(F.col("quality").isNotNull()).drop(*HELPERS)


def stored_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The review table after ingest, before enrichment."""
    return stored_form(keep_first(with_hash(raw_reviews(spark, sf)), ["seq"]))


def enriched_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_reviews(stored_reviews(spark, sf), LEXICON)


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _tag(opening: str, content: Column) -> Column:
    return F.concat(F.lit(f"<{opening}>"), content, F.lit(f"</{opening.split()[0]}>"))


def review_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Captured review pages: at most 600 consecutive reviews of a hotel on each.

    Reviews without text get the generic body row. Some appear twice, the second time with
    other texts that end in the same record: the bare score, and a body row beside a text.
    """
    raw = deliveries(spark, sf)
    no_text = (F.col("positive") == "") & (F.col("negative") == "")
    no_body = _tag('div class="c-review-block__row"', F.concat(F.lit("body of "), F.col("seq")))
    bare = extract_score(F.col("score"))

    def block(score: Column, body: Column) -> Column:
        return F.concat(
            F.lit('<div data-testid="review" class="c-review-block">'),
            _tag('h3 data-testid="review-title"', _escaped(F.col("title"))),
            _tag('div class="badge bui-review-score__badge"', score),
            _tag('span data-testid="review-date"', F.col("date")),
            F.when(
                F.col("positive") != "",
                _tag('div data-testid="review-positive-text"', _tag("div", _escaped(F.col("positive")))),
            ).otherwise(""),
            F.when(
                F.col("negative") != "", _tag('p class="c-review__body--negative"', _escaped(F.col("negative")))
            ).otherwise(""),
            body,
            F.lit("</div>"),
        )

    once = block(F.col("score"), F.when(no_text, no_body).otherwise(""))
    blocks = F.when(F.col("twice"), F.concat(once, block(bare, no_body))).otherwise(once)
    page_no = F.floor(F.col("seq") / SEQS_PER_PAGE)
    blocks = raw.select("hotel_name", "hotel_url", page_no.alias("page_no"), "seq", blocks.alias("b"))
    # a page spans 600 sequence numbers, so the list below has at most 600 items
    pages = blocks.groupBy("hotel_url", "hotel_name", "page_no").agg(
        F.min("seq").alias("page_id"), F.array_sort(F.collect_list(F.struct("seq", "b"))).alias("bs")
    )
    body = F.array_join(F.transform("bs", lambda s: s["b"]), "")
    title = F.concat(F.lit("<title>"), F.col("hotel_name"), F.lit(f" - {SITE}</title>"))
    return pages.select(
        "page_id",
        "page_no",
        F.col("hotel_url").alias("url"),
        F.concat(F.lit("<html><head>"), title, F.lit("</head><body>"), body, F.lit("</body></html>")).alias("html"),
    )


def hotel_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One hotel page per document; its number decides where the name and the review
    count stand, the text fills the body."""
    n = F.col("doc_id")
    name = F.concat(F.col("source"), F.lit(" "), n.cast("string"))
    json = '<script type="application/ld+json">'

    def text(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    heads = [
        text(json, '{"@type":"Hotel","name":"Casa ', name, '"}</script>'),
        text(json, '[{"@type":"WebPage","name":"x"},{"@type":"LodgingBusiness","name":"Lista ', name, '"}]</script>'),
        text(json, '{"@type": "Hotel", </script><meta content="Villa ', name, ', Centro" property="og:title">'),
        text(json, '{"@type":"Resort","name":"x"}</script><h2 id="hp_hotel_name"><b>Posada</b> &amp; ', name, "</h2>"),
        text('<meta property="og:title" content=",', name, '">'),
        text('<div class="big hp__hotel-name"><div>Hostal</div>', name, "</div>"),
        text('<h2 class="pp-header__title"> Hotel ', name, " </h2>"),
        text("<title>Updated Prices Finca ", name, f" -- {SITE} reviews</title>"),
    ]
    counts = [
        text('<a data-testid="review-score-link"><div>8,5</div><div>Opiniones (', n.cast("string"), ")</div></a>"),
        text('<span class="d8eab2cf7f">', n.cast("string"), ".5 comentarios</span>"),
        text('<a class="js-review-tab-link">Reviews</a><span class="bui-review-score__text">', n.cast("string"), "</span>"),
        text("<p>", n.cast("string"), "</p>"),
    ]

    def pick(options: list[Column]) -> Column:
        chosen = options[-1]
        for i, option in enumerate(options[:-1]):
            chosen = F.when(n % len(options) == i, option).otherwise(chosen)
        return chosen

    return table(spark, sf, "documents").select(
        n.alias("page_id"),
        F.concat(F.lit("https://stay.example/page/"), n.cast("string")).alias("url"),
        text("<html><body>", pick(heads), pick(counts), "<p>", _escaped(F.col("text")), "</p></body></html>").alias("html"),
    )


def search_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The given pages with a few result cards in front of their own content."""
    cards = [
        '<div data-testid="property-card"><a class="x e3859ef1a4" href="/hotel/', (F.col("page_id") % 97).cast("string"),
        '">A</a><a data-testid="title-link" href="', F.col("url"),
        '">B</a><h3 class="c-property-card__title"><span><a href="https://stay.example/card/', F.col("page_id").cast("string"),
        '">C</a></span></h3><a class="other" href="/ad">D</a><a data-testid="title-link" href="">E</a>',
        "<a title=it's class=e3859ef1a4 href=\"/a/./b/../../hotel/", (F.col("page_id") % 89).cast("string"),
        '?a=1&amp;b=2">F</a></div>',
    ]
    front = F.concat(*(F.lit(c) if isinstance(c, str) else c for c in cards))
    return table(spark, sf, "pages").select("page_id", "url", F.concat(front, F.col("html")).alias("html"))
