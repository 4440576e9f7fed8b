"""Exact duplicates: heavy-hitter split of the text digests."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.llm.common import keep_decided
from guestlens.session import stage

# A digest with at least this share of all rows counts as heavy, so there are at most
# 1 / SUPPORT heavy digests whatever the input.
SUPPORT = 0.005


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space. Single spaces are left alone,
    so the pattern matches only where something changes."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Heavy-hitter split. The digests of all texts are stored once. Misra-Gries counters
    (Spark's frequent items) propose the digests with a share of `support` or more; one
    combining pass counts the proposed ones exactly and finds the row each of them
    keeps. Those verified winners, at most 1 / support rows, are broadcast, and their
    copies are decided where they lie. All other digests are counted by an ordinary
    shuffle, in which no group holds more than `support` of the rows.

    Null texts count as empty. Of equal texts the row with the smallest doc_id stays, a
    null doc_id last; of rows with the same doc_id the first stored one. keep_id is null
    when every row of the group has a null id. An empty table gives no rows. Other
    columns are not looked at.
    """
    rows = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            text_digest(F.col(text)).alias("text_sha256"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "digests",
    )
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    counted = (F.min(place).alias("_best"), F.count(F.lit(1)).alias("group_size"))

    total = rows.count()
    proposed = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    # bounded by the number of counters
    proposed = F.broadcast(proposed.distinct())
    winners = rows.join(proposed, "text_sha256", "left_semi").groupBy("text_sha256").agg(*counted)
    winners = stage(winners.where(F.col("group_size") >= support * total), "heavy-digests")

    heavy = rows.join(F.broadcast(winners), "text_sha256")
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    light = light.join(stage(light.groupBy("text_sha256").agg(*counted), "light-digests"), "text_sha256")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without exact copies, with all their columns; see `exact_dedup`."""
    decided = exact_dedup(docs, doc_id, text).select("doc_id", F.col("text_sha256").alias("key"), "kept")
    return keep_decided(docs, stage(decided, "exact-kept"), doc_id, text_digest(F.col(text)))
