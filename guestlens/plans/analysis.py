"""Enrichment and the dashboard figures."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestlens.operators import enrich, metrics, terms
from guestlens.operators.filters import ALL_HOTELS, corpus, filter_dates, filter_hotel, prepare
from guestlens.session import stage


def enrich_reviews(reviews: DataFrame, lexicon: enrich.Lexicon = enrich.SENTIMENT_LEXICON) -> DataFrame:
    """Every review gets text and language, every Spanish or English one a sentiment."""
    return enrich.with_lexicon_sentiment(enrich.with_language(enrich.with_processed_text(reviews)), lexicon)


def explorer(
    reviews: DataFrame,
    hotel: str = ALL_HOTELS,
    start: datetime.date | None = None,
    end: datetime.date | None = None,
) -> DataFrame:
    """Prepared reviews of a hotel and a date range, all columns."""
    return filter_dates(filter_hotel(prepare(reviews), hotel), start, end)


def overview(
    reviews: DataFrame,
    hotel: str = ALL_HOTELS,
    start: datetime.date | None = None,
    end: datetime.date | None = None,
) -> DataFrame:
    """All dashboard figures as rows (section, item, value); terms are those of the
    clouds: words and collocations, none when there is too little text.

    The prepared frame is staged once without its long unused columns. One aggregate
    over it gives all counts and means (`metrics.figures`), and one pass over the texts
    of both clouds their terms; every section is a few rows of these two.
    """
    prepared = prepare(reviews)
    wanted = ["hotel_name", "review_date", "score", "compound_score", "sentiment_label", "positive", "negative"]
    prepared = stage(prepared.select(*(c for c in wanted if c in prepared.columns)), "prepared")
    chosen = filter_dates(filter_hotel(prepared, hotel), start, end)
    # the ranking ignores the date filter, and is of all hotels only
    within = F.lit(True) if start is None or end is None else F.col("review_date").between(start, end)
    found = stage(metrics.figures(filter_hotel(prepared, hotel), within), "figures")

    def rows(section: str, frame: DataFrame, item: str, value: str) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"),
            F.col(item).cast("string").alias("item"),
            F.col(value).cast("double").alias("value"),
        )

    def of(kind: str) -> DataFrame:
        return found.where((F.col("kind") == kind) & (F.col("n") > 0))

    kpis = of("kpi").select(F.col("n").cast("double").alias("reviews"), F.col("compound").alias("avg_compound"), F.col("score").alias("avg_score"))
    months = of("month").where(F.col("month").isNotNull())
    parts = [
        rows("kpi", kpis.unpivot([], kpis.columns, "item", "value"), "item", "value"),
        rows("monthly_sentiment", months.where(F.col("compound").isNotNull()), "month", "compound"),
        rows("monthly_volume", metrics.with_empty_months(months.select("month", "n")), "month", "reviews"),
    ]
    if "sentiment_label" in prepared.columns:
        parts.append(rows("sentiment", of("label").where(F.col("label").isNotNull()), "label", "n"))
    if hotel == ALL_HOTELS:
        hotels = found.where((F.col("kind") == "hotel") & F.col("hotel").isNotNull())
        ranking = metrics.ranked(hotels.select(F.col("hotel").alias("hotel_name"), F.col("compound_of_all").alias("compound_score")))
        parts.append(rows("ranking", ranking, "hotel_name", "compound_score"))
    sides = {"positive": "POS", "negative": "NEG"}
    texts = [corpus(chosen, column, label).select(F.lit(column).alias("side"), "text") for column, label in sides.items()]
    if all(column in chosen.columns for column in sides):  # one scan for both
        both = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("text")) for c in sides)))
        texts = [chosen.select(both.alias("_t")).select("_t.*").where(F.col("text").isNotNull())]
    counts = texts[0]
    for more in texts[1:]:
        counts = counts.unionByName(more)
    counts = stage(terms.clouds_counts(counts, ["side"]), "clouds")
    parts += [rows(f"terms_{c}", terms.top_terms(counts.where(F.col("side") == c).drop("side")), "term", "n") for c in sides]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
