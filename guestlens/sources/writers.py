"""Sinks of the review data."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.functions.dates import parse_review_date
from guestlens.functions.scores import normalize_score
from guestlens.operators.dedup import ROW_BYTES, SMALL_BATCH_BYTES, keep_first, new_rows, with_hash
from guestlens.schema import RAW_COLUMNS, REVIEW, STORED_COLUMNS
from guestlens.session import stage, staging
from guestlens.sources import hashindex, table
from guestlens.sources.readers import CSV_OPTIONS

# A CSV file with line breaks inside quotes is read by one task, so files stay moderate.
_CSV_ROWS_PER_FILE = 500_000


def stored_form(raw: DataFrame) -> DataFrame:
    """Raw reviews with hash as rows of the stored table: clean score, parsed date,
    enrichment not done yet (null text columns, zero scores)."""
    unset = F.lit(None).cast("string")
    columns = {
        "score": normalize_score(F.col("score")),
        "review_date": parse_review_date(F.col("date")),
        "language": unset,
        "full_review_processed": unset,
        "sentiment_label": unset,
        "sentiment_score_pos": F.lit(0.0),
        "sentiment_score_neg": F.lit(0.0),
        "sentiment_score_neu": F.lit(0.0),
        "created_at": F.current_timestamp(),
    }
    if "seq" not in raw.columns:
        columns["seq"] = F.lit(None).cast("bigint")
    stored = raw.withColumns(columns)
    return stored.withColumn("review_month", F.trunc("review_date", "month")).select(*STORED_COLUMNS)


def write_by_month(rows: DataFrame, path: str, ingest_id: str) -> None:
    """Writes rows with a review_month into the partitions (month, ingest) of the table, in
    place of what the same ingest has stored before; all others stay."""
    spark = rows.sparkSession
    add = table.write(rows, path, ingest_id)

    def replace() -> None:
        seen = table.current(spark, path)
        own = {p for p in seen.parts if p.ingest_id == ingest_id} - set(add)
        table.commit(spark, path, seen, add, own, months=set())

    table.retried(replace)


def insert_new(
    batch: DataFrame,
    path: str,
    ingest_id: str | None = None,
    csv_path: str | None = None,
    schema: T.StructType = REVIEW,
    form: Callable[[DataFrame], DataFrame] = stored_form,
) -> dict[str, int]:
    """Stores the raw reviews of a batch that no other ingest has brought. Returns
    batch_size, undated and newly_saved.

    Within the batch the smallest seq wins; across batches the one that came first. The
    date is part of the hash, so a review is compared with those of its own month only,
    undated ones with the undated; a late one like any other. Of large folders of these
    months the hash filters are asked first, and only those that may hold a hash of the
    batch are read (`unseen`). What the same ingest has stored before is replaced in the
    same step, so running a batch again after a crash adds nothing; another writer's rows
    are never touched, and if one comes first, the batch is compared again.
    """
    spark = batch.sparkSession
    ingest_id = ingest_id or f"batch-{uuid.uuid4().hex}"
    size = Observation()
    with staging(spark):
        given = with_hash(batch.observe(size, F.count(F.lit(1)).alias("n")))
        month = F.trunc(parse_review_date(F.col("date")), "month")
        arrived = stage(given.withColumns({"review_month": month, "_row": F.monotonically_increasing_id()}), "arrived")
        # which rows are the first and which of them are new is found without their texts
        first = keep_first(arrived.select("review_hash", "review_month", "seq", "_row"), ["seq", "_row"])
        first = stage(first.drop("seq"), "first")
        # at most one row per calendar month
        counts = {r["review_month"]: r["count"] for r in first.groupBy("review_month").count().collect()}
        rows, undated = sum(counts.values()), counts.pop(None, 0)
        per_month = {m.isoformat(): n for m, n in counts.items()} | ({table.UNDATED: undated} if undated else {})

        def insert() -> int:
            seen = table.current(spark, path)
            own = {p for p in seen.parts if p.ingest_id == ingest_id}
            if not rows and not own:
                return 0
            saved = Observation()
            chosen = unseen(first, path, table.Version(seen.number, seen.parts - own), per_month, schema).select("_row")
            # hashed in any case, so that no text is sorted
            chosen = chosen.hint("broadcast" if rows * ROW_BYTES <= SMALL_BATCH_BYTES else "shuffle_hash")
            fresh = arrived.join(chosen, "_row", "left_semi").drop("_row")
            if csv_path is not None:
                fresh = stage(fresh, "fresh")
            fresh = fresh.observe(saved, F.count(F.lit(1)).alias("n"))
            add = table.write(form(fresh), path, ingest_id, per_month)
            if add or own:
                table.commit(spark, path, seen, add, own, months=set(per_month))
            if csv_path is not None:
                write_review_csv(fresh, f"{csv_path}/ingest_id={ingest_id}")
            # the plan of nothing new may leave the observation out
            return saved.get["n"] if add else 0

        newly_saved = table.retried(insert)
    return {"batch_size": size.get["n"] if rows else 0, "undated": undated, "newly_saved": newly_saved}


def unseen(arrived: DataFrame, path: str, seen: table.Version, per_month: dict[str, int], schema: T.StructType = REVIEW) -> DataFrame:
    """Rows of `arrived` (one per review_hash, with its review_month) that the version does
    not hold. `per_month` has their number by month. A large folder is read only if its
    hash filter lets one of these hashes through, and then for those hashes."""
    spark, rows = arrived.sparkSession, sum(per_month.values())
    parts = [p for p in seen.parts if p.month in per_month]
    asked = arrived.select("review_month", "review_hash")
    held = table.read(spark, path, schema, seen, lambda p: p in parts and not p.blocks).select("review_hash")
    if any(p.blocks for p in parts):
        let_through = stage(hashindex.may_hold(spark, path, asked, parts), "may-be-held")
        # at most one row per large folder
        folders = {r["folder"] for r in let_through.select("folder").distinct().collect()}
        if folders:
            large = table.read(spark, path, schema, seen, lambda p: p.folder in folders)
            held = held.unionByName(large.join(let_through.select("review_hash").distinct(), "review_hash", "left_semi").select("review_hash"))
    return new_rows(arrived, held, rows)


def export_projection(reviews: DataFrame) -> DataFrame:
    return reviews.select(*RAW_COLUMNS)


def write_review_csv(reviews: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The seven review columns as CSV files with header. Overwriting with no rows
    leaves what is there."""
    if mode == "overwrite" and reviews.isEmpty():
        return
    (
        export_projection(reviews)
        .write.mode(mode)
        .options(**CSV_OPTIONS, emptyValue="", maxRecordsPerFile=_CSV_ROWS_PER_FILE)
        .csv(path)
    )


def append_reviews(new: DataFrame, table_path: str, csv_path: str | None = None) -> None:
    """Adds rows known to be new: clean scores to the table, raw score texts to the CSV.

    `new` holds raw reviews with hash. It is staged when it feeds both sinks. The table is
    the one that streams write to as well; every call is an ingest of its own.
    """
    ingest_id = f"batch-{uuid.uuid4().hex}"
    if csv_path is None:
        write_by_month(stored_form(new), table_path, ingest_id)
        return
    with staging(new.sparkSession):
        staged = stage(new, "new-reviews")
        write_by_month(stored_form(staged), table_path, ingest_id)
        write_review_csv(staged, csv_path, mode="append")


def store_enrichment(spark: SparkSession, table_path: str, enrich: Callable[[DataFrame], DataFrame]) -> int:
    """Stores what `enrich` adds to the rows that are not enriched yet, which are those
    without a language. Only folders that hold such rows are read and replaced, all at
    once with the new version. Returns the number of rows enriched."""
    return table.update(spark, table_path, F.col("language").isNull(), enrich)


def save_bucketed(reviews: DataFrame, name: str, buckets: int) -> None:
    """Review table of the catalog, bucketed by hash: insert-if-new then reads the
    table side without a shuffle."""
    reviews.write.mode("overwrite").bucketBy(buckets, "review_hash").saveAsTable(name)


def rewrite_distinct(df: DataFrame, name: str = "distinct") -> tuple[DataFrame, int]:
    """Whole-row distinct in a new table, for use only when there are duplicates.

    Returns the frame to use from now on, which is the given one when nothing was
    removed, and the number of rows removed. One shuffle yields both. The input path is
    never overwritten; the caller switches to the new one.
    """
    copies = stage(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies")), name)
    removed = copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0))).first()[0]
    return (copies.drop("_copies"), removed) if removed else (df, 0)


def create_table(spark: SparkSession, path: str) -> None:
    """Empty table at a new path; an existing table is kept."""
    table.create(spark, path)
