"""Bloom filters of the hashes in large folders of the stored table, kept beside the data.

A filter is a table of blocks. A hash (32 hexadecimal digits) names a block of its folder
and one bit in each of the block's eight words; all of them are set if the folder holds it.
At 21 hashes a block a hash that is not there has all its bits set once in 25,000 times.
"""

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "_hashes"
PER_BLOCK = 21
# Rows from which a folder gets a filter; of smaller ones the hashes themselves are read.
LARGE = 50_000
_WORDS = [f"w{i}" for i in range(8)]


def _block(review_hash: Column, blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(review_hash, 1, 12), 16, 10).cast("long"), blocks.cast("long"))


def _bit(review_hash: Column, word: int) -> Column:
    """A long with the one bit that a hash has in a word."""
    number = F.conv(F.substring(review_hash, 13 + 2 * word, 2), 16, 10).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)))


def build(spark: SparkSession, path: str, token: str, parts: list, rows_of: dict[str, int], large: int | None = None) -> list:
    """The parts of one write, the large ones with their number of blocks, for which filters
    are stored. `rows_of` has the most rows there can be of each month; a filter with fewer
    is sparser."""
    large = LARGE if large is None else large
    blocks = {p.month: -(-rows_of[p.month] // PER_BLOCK) for p in parts if rows_of.get(p.month, 0) >= large}
    if not blocks:
        return parts
    # one row per large folder
    sizes = spark.createDataFrame([(p.folder, blocks[p.month]) for p in parts if p.month in blocks], "folder string, blocks long")
    folders = [f"{path}/{p.folder}" for p in parts if p.month in blocks]
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(review_month=[^/]*/ingest_id=[^/]*)/[^/]*$", 1)
    held = spark.read.schema("review_hash string").parquet(*folders).select(F.url_decode(name).alias("folder"), "review_hash")
    held = held.join(F.broadcast(sizes), "folder").select("folder", _block(F.col("review_hash"), F.col("blocks")).alias("block"), "review_hash")
    bits = [F.bit_or(_bit(F.col("review_hash"), i)).alias(w) for i, w in enumerate(_WORDS)]
    held.groupBy("folder", "block").agg(*bits).write.parquet(f"{path}/{FOLDER}/{token}")
    return [replace(p, blocks=blocks.get(p.month, 0)) for p in parts]


def may_hold(spark: SparkSession, path: str, hashes: DataFrame, parts: list) -> DataFrame:
    """(folder, review_hash) of all pairs of a hash and a part with a filter that may hold
    it; `hashes` has review_month and review_hash. Hashes are asked of their month only."""
    indexed = [p for p in parts if p.blocks]
    if not indexed:
        return spark.createDataFrame([], "folder string, review_hash string")
    # one row per large folder
    sizes = spark.createDataFrame([(p.folder, p.month, p.blocks) for p in indexed], "folder string, _month string, blocks long")
    month = F.coalesce(F.col("review_month").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    asked = hashes.select(month.alias("_month"), "review_hash").join(F.broadcast(sizes), "_month")
    asked = asked.select("folder", _block(F.col("review_hash"), F.col("blocks")).alias("block"), "review_hash")
    schema = "folder string, block long, " + ", ".join(f"{w} long" for w in _WORDS)
    tokens = sorted({p.token for p in indexed})
    filters = spark.read.schema(schema).parquet(*(f"{path}/{FOLDER}/{t}" for t in tokens))
    met = asked.join(filters, ["folder", "block"])
    for i, w in enumerate(_WORDS):
        met = met.where(F.col(w).bitwiseAND(_bit(F.col("review_hash"), i)) != 0)
    return met.select("folder", "review_hash")
