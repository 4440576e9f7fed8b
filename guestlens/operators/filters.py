"""Preparation and filters of the analysis frame."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.functions.dates import parse_review_date
from guestlens.functions.scores import compound_proxy, compound_sentiment, normalize_score, normalize_score_number

# Fixed value: the choice that stands for every hotel.
ALL_HOTELS = "Todos"


def drop_undated(df: DataFrame) -> DataFrame:
    return df.where(F.col("review_date").isNotNull())


def with_review_date(df: DataFrame) -> DataFrame:
    """Adds the parsed date; a table that already stores it is left alone, so that
    filters on it reach the scan."""
    if "review_date" in df.columns or "date" not in df.columns:
        return df
    return df.withColumn("review_date", parse_review_date(F.col("date")))


def with_compound(df: DataFrame) -> DataFrame:
    """Compound score from sentiment where the columns exist, else from the score, else 0."""
    if {"sentiment_score_pos", "sentiment_score_neg"} <= set(df.columns):
        value = compound_sentiment(F.col("sentiment_score_pos"), F.col("sentiment_score_neg"))
    elif "score" in df.columns:
        value = compound_proxy(F.col("score"))
    else:
        value = F.lit(0.0)
    return df.withColumn("compound_score", value)


def prepare(df: DataFrame) -> DataFrame:
    """Parsed date, undated rows dropped, score on the 10-point scale, compound score."""
    df = with_review_date(df)
    if "review_date" in df.columns:
        df = drop_undated(df)
    if "score" in df.columns:
        textual = isinstance(df.schema["score"].dataType, T.StringType)
        normalize = normalize_score if textual else normalize_score_number
        df = df.withColumn("score", normalize(F.col("score")))
    return with_compound(df)


def filter_hotel(df: DataFrame, hotel: str = ALL_HOTELS) -> DataFrame:
    return df if hotel == ALL_HOTELS else df.where(F.col("hotel_name") == hotel)


def filter_dates(df: DataFrame, start: datetime.date | None, end: datetime.date | None) -> DataFrame:
    """Rows dated from `start` to `end`, both included; no filter unless both are given."""
    if start is None or end is None:
        return df
    if "review_month" in df.columns:  # prunes the partitions of a stored table
        df = df.where(F.col("review_month").between(F.lit(start.replace(day=1)), F.lit(end)))
    return df.where(F.col("review_date").between(F.lit(start), F.lit(end)))


def filter_months(df: DataFrame, months: list[datetime.date | None]) -> DataFrame:
    """Rows of the given months of a stored table; None stands for undated rows."""
    chosen = F.col("review_month").isin([m for m in months if m is not None])
    return df.where(chosen | F.col("review_month").isNull() if None in months else chosen)


def corpus(df: DataFrame, column: str, label: str) -> DataFrame:
    """(text): the column where it exists, else title and cleaned text of rows with the label."""
    if column in df.columns:
        return df.where(F.col(column).isNotNull()).select(F.col(column).alias("text"))
    if "sentiment_label" not in df.columns:
        return df.select(F.lit(None).cast("string").alias("text")).where(F.lit(False))
    # a missing part reads as the text None, like every stringified null here
    parts = [F.coalesce(F.col(c), F.lit("None")) for c in ("title", "full_review_processed")]
    return df.where(F.col("sentiment_label") == label).select(F.concat_ws(" ", *parts).alias("text"))
