"""Stream ingest: batches of raw reviews into the review table, each review once."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from guestlens.schema import RAW_REVIEW, REVIEW
from guestlens.sources import table
from guestlens.sources.writers import create_table, insert_new, stored_form

# Batches of a stream after which small folders are merged.
COMPACT_EVERY = 32

SEQUENCED_RAW = T.StructType([T.StructField("seq", T.LongType()), *RAW_REVIEW.fields])

Counts = dict[str, int]
Report = Callable[[int, Counts], None]


def read_batches(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Stream over a folder of raw review files, oldest file first."""
    return spark.readStream.schema(SEQUENCED_RAW).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_batch(
    batch: DataFrame,
    ingest_id: str,
    table_path: str,
    csv_path: str | None = None,
    schema: T.StructType = REVIEW,
    form: Callable[[DataFrame], DataFrame] = stored_form,
) -> Counts:
    """Stores the reviews of one batch that no other ingest has brought (`insert_new`).

    What a batch has stored becomes part of the table at once, or not at all, and a batch
    that runs again replaces its own rows; once they are merged with others, it finds all
    of them stored. Returns batch_size, undated and newly_saved.
    """
    return insert_new(batch, table_path, ingest_id, csv_path, schema, form)


def _run(batches: DataFrame, checkpoint: str, store: Callable[[DataFrame, str], Counts], report: Report | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        # The id of a query lives in its checkpoint: the same after a restart, another
        # one with a fresh checkpoint, whose batches count from 0 again.
        query = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        counts = store(batch, f"{query}-{batch_id}")
        if report is not None:
            report(batch_id, counts)

    return (
        batches.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_ingest(
    batches: DataFrame,
    table_path: str,
    checkpoint: str,
    csv_path: str | None = None,
    report: Report | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Ingests all that is available, then stops. The table may already hold reviews of
    batch runs or other streams, which may write at the same time.

    `report` gets the number and the counts of each batch. After every `compact_every`
    batches small folders are merged, so that a month keeps a bounded number of them.
    """
    create_table(batches.sparkSession, table_path)

    def store(batch: DataFrame, ingest_id: str) -> Counts:
        counts = ingest_batch(batch, ingest_id, table_path, csv_path)
        if (int(ingest_id.rpartition("-")[2]) + 1) % compact_every == 0:
            table.compact(batch.sparkSession, table_path)
        return counts

    return _run(batches, checkpoint, store, report)


def start_distinct(
    batches: DataFrame, path: str, checkpoint: str, columns: T.StructType, report: Report | None = None
) -> StreamingQuery:
    """Exact duplicate removal of a stream of raw reviews: the first arrival of every
    hash, late and undated ones included, however late. `columns` of it are kept at
    `path`, which stands in for a state and may grow without bound: a batch reads the
    hashes of its own months only."""
    schema = T.StructType([*columns.fields, *(f for f in REVIEW.fields if f.name in ("review_month", "ingest_id"))])
    create_table(batches.sparkSession, path)
    form = lambda fresh: fresh.select(*columns.names, "review_month")

    def store(batch: DataFrame, ingest_id: str) -> Counts:
        counts = ingest_batch(batch, ingest_id, path, None, schema, form)
        if (int(ingest_id.rpartition("-")[2]) + 1) % COMPACT_EVERY == 0:
            table.compact(batch.sparkSession, path, schema)
        return counts

    return _run(batches, checkpoint, store, report)
