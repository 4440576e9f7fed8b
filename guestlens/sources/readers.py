"""Review tables, review CSV files and captured pages."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.schema import RAW_REVIEW, REVIEW
from guestlens.sources import table

# Texts hold line breaks and quotes; blanks at the edges are part of the text.
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def read_reviews(spark: SparkSession, path: str, schema: T.StructType = REVIEW, version: int | None = None) -> DataFrame:
    """Stored review table in its newest version or an earlier one, or a Parquet folder
    that no writer of this library made; the schema is declared, never inferred."""
    found = table.current(spark, path, version)
    if not found.number and not found.parts:
        return spark.read.schema(schema).parquet(path)
    return table.read(spark, path, schema, found)


def read_reviews_jdbc(
    spark: SparkSession, url: str, bounds: tuple[int, int], table: str = "reviews", parts: int = 64, **options
) -> DataFrame:
    """Review table of a database, read in `parts` ranges of its id. `bounds` are its
    smallest and largest id; they deal the rows to tasks and leave none out."""
    ranges = {"partitionColumn": "id", "numPartitions": parts, "lowerBound": bounds[0], "upperBound": bounds[1]}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **ranges, **options).load()


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """Review CSV. Empty fields read null. A file with line breaks inside quotes cannot
    be split, so the writer keeps its files moderate and the files are the parallelism.

    Columns are taken by name: a header in another order is fine, and a missing or
    empty file gives an empty frame.
    """
    try:
        found = spark.read.options(**CSV_OPTIONS).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RAW_REVIEW)
    return found.select(
        *(F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in RAW_REVIEW.names)
    )


def processed_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Distinct processed urls of a review CSV; empty when the file is missing, empty or
    has no url column."""
    urls = read_review_csv(spark, path).select(F.col("hotel_url").alias("url"))
    return urls.where(F.col("url").isNotNull()).distinct()


def reviews_or_fallback(spark: SparkSession, table_path: str, csv_path: str) -> DataFrame:
    """The table when it has rows, else the CSV, else an empty frame.

    The two have different columns; callers test for the ones they need.
    """
    try:
        reviews = read_reviews(spark, table_path)
        if not reviews.isEmpty():
            return reviews
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return read_review_csv(spark, csv_path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages as rows (page_id, url, html)."""
    return spark.read.schema(PAGE).parquet(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages as single HTML files; the file name is the url, its 64-bit hash the
    id. No operator groups pages by id alone."""
    files = spark.read.text(path, wholetext=True)
    name = F.input_file_name()
    return files.select(F.xxhash64(name).alias("page_id"), name.alias("url"), F.col("value").alias("html"))
