"""Declared schemas of the review data."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW_COLUMNS = ["hotel_name", "hotel_url", "title", "score", "positive", "negative", "date"]

RAW_REVIEW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

# The stored table. `review_date` is parsed once at ingest so that date filters
# reach the Parquet scan; the raw text stays next to it. The table is partitioned by
# `review_month`, the first day of the month: date filters prune partitions, and since
# the date is part of the hash, a review can only repeat one of its own month. Below the
# month, `ingest_id` keeps apart what each batch run or stream batch brought.
REVIEW = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("hotel_name", T.StringType()),
        T.StructField("hotel_url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("positive", T.StringType()),
        T.StructField("negative", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("review_date", T.DateType()),
        T.StructField("review_hash", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("full_review_processed", T.StringType()),
        T.StructField("sentiment_label", T.StringType()),
        T.StructField("sentiment_score_pos", T.DoubleType()),
        T.StructField("sentiment_score_neg", T.DoubleType()),
        T.StructField("sentiment_score_neu", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("review_month", T.DateType()),
        T.StructField("ingest_id", T.StringType()),
    ]
)

# What a row says itself; the writer adds which ingest brought it.
STORED_COLUMNS = REVIEW.names[:-1]

ENRICHMENT_COLUMNS = [
    "language",
    "full_review_processed",
    "sentiment_label",
    "sentiment_score_pos",
    "sentiment_score_neg",
    "sentiment_score_neu",
]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df
