"""Sums of the stored reviews by day, hotel and label, kept beside the data per folder.

Folders never change, so the sums of a folder are made once. After a new ingest, an
enrichment or a merge only the new folders are read; the figures of any version are the sums
of its folders' rows, for any hotel and range of days.
"""

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.functions.dates import month_end
from guestlens.operators import metrics
from guestlens.operators.filters import ALL_HOTELS, filter_dates, filter_hotel, prepare
from guestlens.sources import table

FOLDER = "_sums"
_KEYS = ["review_date", "hotel_name", "sentiment_label"]
_SCHEMA = (
    "folder string, review_date date, hotel_name string, sentiment_label string, n long, n_compound long, "
    "compound double, n_score long, score double, run string"
)


def _sums(spark: SparkSession, path: str) -> DataFrame:
    """What finished runs have made; where two have made the sums of a folder, one of them."""
    runs = [f.getPath().getParent().toString() for f in table.listed(spark, path, f"{FOLDER}/*/_SUCCESS")]
    if not runs:
        return spark.createDataFrame([], _SCHEMA)
    sums = spark.read.schema(_SCHEMA).parquet(*runs)
    # one row per folder
    first = sums.groupBy("folder").agg(F.min("run").alias("run"))
    return sums.join(F.broadcast(first), ["folder", "run"])


def refresh(spark: SparkSession, path: str, version: table.Version | None = None) -> int:
    """Makes the sums of the folders of a version that have none, by one job that reads only
    these, and returns their number."""
    version = version or table.current(spark, path)
    made = {r["folder"] for r in _sums(spark, path).select("folder").distinct().collect()}
    missing = {p for p in version.parts if p.folder not in made}
    if not missing:
        return 0
    rows = prepare(table.read(spark, path, version=version, keep=lambda p: p in missing, folder="folder"))
    sums = rows.groupBy("folder", *_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("compound_score").alias("n_compound"),
        F.sum("compound_score").alias("compound"),
        F.count("score").alias("n_score"),
        F.sum("score").alias("score"),
    )
    # a folder without dated reviews is done as well
    marks = spark.createDataFrame([(p.folder, 0) for p in missing], "folder string, n long")
    run = uuid.uuid4().hex
    whole = sums.unionByName(marks, allowMissingColumns=True).withColumn("run", F.lit(run))
    whole.hint("rebalance").write.parquet(f"{path}/{FOLDER}/{run}")
    return len(missing)


def _mean(total: str, count: str) -> Column:
    return F.try_divide(F.sum(total), F.sum(count))


class Figures:
    """The dashboard's counts and means of a version, from sums alone. A hotel and a range of
    days, both ends included, may be chosen; the ranking is of all days."""

    def __init__(
        self, spark: SparkSession, path: str, hotel: str = ALL_HOTELS,
        start: datetime.date | None = None, end: datetime.date | None = None, version: table.Version | None = None,
    ):
        version = version or table.current(spark, path)
        refresh(spark, path, version)
        live = spark.createDataFrame([(p.folder,) for p in version.parts], "folder string")
        # one row per folder
        self.every = _sums(spark, path).join(F.broadcast(live), "folder", "left_semi").where(F.col("n") > 0)
        self.chosen = filter_dates(filter_hotel(self.every, hotel), start, end)

    def kpis(self) -> DataFrame:
        """As `metrics.kpis`."""
        found = self.chosen.agg(F.sum("n").alias("reviews"), _mean("compound", "n_compound").alias("avg_compound"), _mean("score", "n_score").alias("avg_score"))
        return found.where(F.col("reviews") > 0)

    def sentiment_distribution(self) -> DataFrame:
        """(sentiment_label, reviews), most frequent first."""
        labels = self.chosen.where(F.col("sentiment_label").isNotNull()).groupBy("sentiment_label")
        return labels.agg(F.sum("n").alias("reviews")).orderBy(F.desc("reviews"), "sentiment_label")

    def monthly_sentiment(self) -> DataFrame:
        """As `metrics.monthly_sentiment`."""
        months = self.chosen.groupBy(month_end(F.col("review_date")).alias("month"))
        return months.agg(_mean("compound", "n_compound").alias("compound_score")).where(F.col("compound_score").isNotNull()).orderBy("month")

    def monthly_volume(self) -> DataFrame:
        """As `metrics.monthly_volume`."""
        return metrics.with_empty_months(self.chosen.groupBy(month_end(F.col("review_date")).alias("month")).agg(F.sum("n").alias("n")))

    def hotel_ranking(self, size: int = metrics.RANKING_SIZE) -> DataFrame:
        """As `metrics.hotel_ranking`."""
        hotels = self.every.where(F.col("hotel_name").isNotNull()).groupBy("hotel_name")
        return metrics.ranked(hotels.agg(_mean("compound", "n_compound").alias("compound_score")), size)
