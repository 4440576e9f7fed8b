"""Counts, KPIs, rankings and monthly trends."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestlens.functions.dates import month_end, parse_review_date
from guestlens.functions.text import has_empty_body
from guestlens.session import stage

# Fixed value: length of the hotel ranking.
RANKING_SIZE = 10


def review_count(df: DataFrame, *more: Column) -> DataFrame:
    """Number of reviews, and further aggregates if given."""
    return df.agg(F.count(F.lit(1)).alias("reviews"), *more)


def date_rejects(df: DataFrame) -> DataFrame:
    """Reviews whose date text was read, is blank, or is in no accepted form. The last
    two are left out of every metric."""
    text, date = F.trim(F.coalesce("date", F.lit(""))), parse_review_date(F.col("date"))
    return df.select(text.alias("_text"), date.alias("_date")).agg(
        F.count("_date").alias("dated"),
        F.count_if(F.col("_date").isNull() & (F.col("_text") == "")).alias("blank"),
        F.count_if(F.col("_date").isNull() & (F.col("_text") != "")).alias("unread"),
    )


def empty_body_audit(df: DataFrame) -> DataFrame:
    """Reviews in total, without body, and with body, in one pass."""
    empty = has_empty_body(F.col("positive"), F.col("negative"))
    counted = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(empty).alias("empty_body"))
    return counted.withColumn("with_body", F.col("total") - F.col("empty_body"))


def hotel_list(df: DataFrame) -> DataFrame:
    """Sorted distinct names; a null name reads `None`."""
    return df.select(F.coalesce("hotel_name", F.lit("None")).alias("hotel_name")).distinct().orderBy("hotel_name")


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("review_date").alias("min_date"), F.max("review_date").alias("max_date"))


def kpis(df: DataFrame) -> DataFrame:
    """Number of reviews, mean compound, mean score; no row when there are no reviews."""
    return df.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.avg("compound_score").alias("avg_compound"),
        F.avg("score").alias("avg_score"),
    ).where(F.col("reviews") > 0)


def sentiment_distribution(df: DataFrame) -> DataFrame:
    """Reviews and share per label, most frequent first; unlabelled rows are left out.

    The share needs the total of the per-label counts, a handful of rows.
    """
    counts = df.where(F.col("sentiment_label").isNotNull()).groupBy("sentiment_label").agg(
        F.count(F.lit(1)).alias("reviews")
    )
    total = F.sum("reviews").over(Window.partitionBy())
    return counts.withColumn("share", F.col("reviews") / total).orderBy(F.desc("reviews"), "sentiment_label")


def hotel_ranking(df: DataFrame, size: int = RANKING_SIZE) -> DataFrame:
    """The `size` hotels with the highest mean compound, lowest of them first.

    Takes the frame without date filter. Equal means are ordered by name.
    """
    means = df.where(F.col("hotel_name").isNotNull()).groupBy("hotel_name").agg(
        F.avg("compound_score").alias("compound_score")
    )
    return ranked(means, size)


def ranked(means: DataFrame, size: int = RANKING_SIZE) -> DataFrame:
    top = means.orderBy(F.desc_nulls_last("compound_score"), "hotel_name").limit(size)
    return top.orderBy(F.asc_nulls_first("compound_score"), F.desc("hotel_name"))


def figures(df: DataFrame, chosen: Column) -> DataFrame:
    """All counts and means of the dashboard by one aggregate over one scan: (kind, item
    columns, n, n_compound, compound, score).

    Grouping sets make a row for the whole (`kpi`), each month, label and hotel. Only
    `chosen` rows count, but for the hotels, whose means are over all rows. Sums are
    combined per task, so a task passes on a row per month, label and hotel that it saw.
    """
    label = F.col("sentiment_label") if "sentiment_label" in df.columns else F.lit(None).cast("string")
    keyed = df.select(
        month_end(F.col("review_date")).alias("month"), label.alias("label"), F.col("hotel_name").alias("hotel"),
        F.coalesce(chosen, F.lit(False)).alias("_in"), "compound_score", "score",
    )
    sets = [[F.col("month")], [F.col("label")], [F.col("hotel")], []]
    among = lambda value: F.when(F.col("_in"), F.col(value))
    found = keyed.groupingSets(sets, F.col("month"), F.col("label"), F.col("hotel")).agg(
        F.grouping_id().alias("_set"),
        F.count_if("_in").alias("n"),
        F.avg(among("compound_score")).alias("compound"),
        F.avg(among("score")).alias("score"),
        F.avg("compound_score").alias("compound_of_all"),
    )
    # a bit for each column that is not in the set
    kind = F.when(F.col("_set") == 0b011, "month").when(F.col("_set") == 0b101, "label").when(F.col("_set") == 0b110, "hotel").otherwise("kpi")
    return found.withColumn("kind", kind).drop("_set")


def score_vs_sentiment(df: DataFrame) -> DataFrame:
    label = ["sentiment_label"] if "sentiment_label" in df.columns else []
    return df.select("score", "compound_score", *label, "title", "hotel_name")


def monthly_sentiment(df: DataFrame) -> DataFrame:
    """Mean compound per month end; months without a value are left out."""
    means = df.groupBy(month_end(F.col("review_date")).alias("month")).agg(
        F.avg("compound_score").alias("compound_score")
    )
    return means.where(F.col("compound_score").isNotNull() & F.col("month").isNotNull()).orderBy("month")


def monthly_volume(df: DataFrame) -> DataFrame:
    """Reviews per month end from the first month to the last, 0 where there are none.

    The month counts, at most one per calendar month, are the only thing that is joined
    with the month sequence, so the reviews are scanned once.
    """
    counts = (
        df.where(F.col("review_date").isNotNull())
        .groupBy(month_end(F.col("review_date")).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return with_empty_months(stage(counts, "months"))


def with_empty_months(counts: DataFrame) -> DataFrame:
    """(month, reviews) of stored counts (month, n), with 0 for the months between."""
    bounds = counts.agg(F.min(F.trunc("month", "month")).alias("first"), F.max(F.trunc("month", "month")).alias("last"))
    months = F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("start")
    calendar = bounds.where(F.col("first").isNotNull()).select(months).select(F.last_day("start").alias("month"))
    return (
        calendar.join(counts, "month", "left")
        .select("month", F.coalesce("n", F.lit(0)).alias("reviews"))
        .orderBy("month")
    )
