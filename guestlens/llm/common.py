"""What several training-data operators share."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guestlens.session import stage

# Rows of an id list that may be broadcast: at 16 bytes a row, 32 MB.
_BROADCAST_IDS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet; names differ by more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def totals_before(rows: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """Adds the sum of `amount` over all rows before each one in the given order.

    Rows are range-sorted and stored, since the boundaries of a range shuffle are sampled
    and all readers must see the same ones. Sums run within a partition; the partitions
    before it add one number each.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("_id", F.monotonically_increasing_id()), "in-order")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    sums = placed.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    offsets = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_offset"))
    within = F.sum(amount).over(Window.partitionBy("_part").orderBy("_id")) - F.col(amount)
    # one row per shuffle partition, so this side is small by construction
    summed = placed.withColumn("_within", within).join(F.broadcast(offsets), "_part")
    return summed.withColumn(name, (F.col("_offset") + F.col("_within")).cast("long")).drop("_id", "_part", "_offset", "_within")


def keep_decided(docs: DataFrame, decisions: DataFrame, doc_id: str, key: Column) -> DataFrame:
    """The rows of `docs` whose decision is to stay, with their columns.

    `decisions` (doc_id, key, kept) has one row per document and should be a stored
    table. Documents are filtered by the ids that go, mostly few: broadcast when their
    counted number is small, else a shuffled anti join. Ids that occur more than once
    are decided by (id, key), and of rows with equal id and key one stays.
    """
    by_id = decisions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max("kept").alias("_kept"))
    out = by_id.where((F.col("_n") > 1) | ~F.col("_kept")).select(
        F.col("doc_id").alias("_gone_id"), (F.col("_kept") & (F.col("_n") > 1)).alias("_repeated")
    )
    few = out.count() <= _BROADCAST_IDS
    hint = F.broadcast if few else (lambda df: df)
    same_id = docs[doc_id].eqNullSafe(F.col("_gone_id"))
    once = docs.join(hint(out), same_id, "left_anti")
    repeated = out.where("_repeated")
    if repeated.isEmpty():
        return once
    name = free_name(docs, "_key")
    kept = decisions.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("key").alias("_kept_key")).distinct()
    again = docs.join(hint(repeated), same_id, "left_semi").withColumn(name, key)
    same = again[doc_id].eqNullSafe(F.col("_kept_id")) & again[name].eqNullSafe(F.col("_kept_key"))
    again = again.join(kept, same, "left_semi").dropDuplicates([doc_id, name]).drop(name)
    return once.unionByName(again)
