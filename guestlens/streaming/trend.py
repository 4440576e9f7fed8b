"""Bounded-state duplicate removal and the live trend."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from guestlens.functions.dates import month_end
from guestlens.session import remove


def dedup_within(stream: DataFrame, time: str, horizon: str, key: str = "review_hash") -> DataFrame:
    """First arrival per key, with a state of bounded size: a key is remembered for
    `horizon` of event time, rows that come later than that or have no time are dropped.
    Where none may be lost use `ingest.start_distinct`."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def daily_trend(stream: DataFrame, time: str, value: str) -> DataFrame:
    """(day, n, total, n_valued) per day; the state is one row per day and is kept, so a
    late row still counts in its day."""
    day = F.window(time, "1 day")
    return (
        stream.groupBy(day.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.count(value).alias("n_valued"))
        .select(F.to_date("w.start").alias("day"), "n", "total", "n_valued")
    )


def write_latest(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the complete result of a small aggregate under `path`: a new version per
    batch, which readers see once it is whole (`read_latest`). The version before stays
    for readers that have begun on it, older ones go."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        if batch_id >= 2:
            remove(batch.sparkSession, f"{path}/version={batch_id - 2}")

    return (
        result.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest whole version written by `write_latest`; empty when there is none."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done) or []
    versions = [int(f.getPath().getParent().getName().removeprefix("version=")) for f in found]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={max(versions)}")


def write_append(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        result.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def monthly_from_daily(daily: DataFrame) -> DataFrame:
    """Month totals and means out of the day totals."""
    return (
        daily.groupBy(month_end(F.col("day")).alias("month"))
        .agg(F.sum("n").alias("reviews"), (F.sum("total") / F.sum("n_valued")).alias("mean_value"))
        .orderBy("month")
    )
