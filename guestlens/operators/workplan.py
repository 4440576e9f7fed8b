"""Link harvest, resume, limits and work assignment."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestlens.functions import markup
from guestlens.session import stage

# Largest number of reviews taken per hotel, number of parallel workers.
MAX_REVIEWS_PER_HOTEL = 1000
WORKERS = 8

# Harvest order of a link: the page it was first seen on, and its place there.
LINK_ORDER = ["first_page", "first_place"]

_CAP_BUCKETS = 1024
# Cuts of so many hotels may be broadcast; beyond that texts meet them in salted parts.
_BROADCAST_CUTS = 200_000
_CUT_SALTS = 32


def _first_seen(links: DataFrame) -> DataFrame:
    first = F.min(F.struct("page_id", "place")).alias("_first")
    return links.groupBy("url").agg(first).select(
        "url", F.col("_first.page_id").alias("first_page"), F.col("_first.place").alias("first_place")
    )


def harvest_anchors(pages: DataFrame, tag_pattern: str = "") -> DataFrame:
    """(url, first_page, first_place) of the distinct link targets whose anchor tag
    matches a pattern."""
    hrefs = markup.anchor_hrefs(F.col("html"), tag_pattern)
    links = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(hrefs).alias("place", "href"))
    links = links.withColumn("href", markup.unescape_entities(F.col("href")))
    return _first_seen(links.withColumn("url", markup.resolve_href(F.col("href"), F.col("page_url"))))


def harvest_hotel_links(pages: DataFrame) -> DataFrame:
    """(url, first_page, first_place) of the hotel links in the result cards of search pages."""
    found = pages.select("page_id", F.col("url").alias("page_url"), markup.hotel_hrefs(F.col("html")).alias("_found"))
    links = found.select("page_id", "page_url", F.posexplode("_found.hrefs").alias("place", "href"))
    return _first_seen(links.withColumn("url", markup.resolve_href(F.col("href"), F.col("page_url"))))


def processed_urls(reviews: DataFrame) -> DataFrame:
    return reviews.select(F.col("hotel_url").alias("url")).distinct()


def pending(links: DataFrame, processed: DataFrame) -> DataFrame:
    """Links not processed yet. A null link equals nothing and stays; duplicates stay."""
    return links.join(processed.select("url"), "url", "left_anti")


def limit_links(links: DataFrame, limit: int) -> DataFrame:
    """The first `limit` links in harvest order; 0 keeps all."""
    return links.orderBy(*LINK_ORDER).limit(limit) if limit > 0 else links


def number_rows(rows: DataFrame, *order: str | Column, name: str = "position", total: str | None = None) -> DataFrame:
    """Adds the place of each row, from 0, in the given order, and the row count if asked for.

    Places come from a range-sorted copy: place within the partition plus the sizes of
    the partitions before it. Only one number per partition is ordered globally. The
    copy is staged because the boundaries of a range shuffle are sampled, and both
    readers must see the same ones.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # partition number in the upper bits, running number in the lower 33
    placed = stage(placed.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33).alias("_part")
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part).agg((F.max(place) + 1).alias("_size"))
    running = F.sum("_size").over(Window.orderBy("_part"))
    whole = F.sum("_size").over(Window.partitionBy())
    offsets = sizes.select("_part", (running - F.col("_size")).alias("_offset"), whole.alias("_total"))
    # one row per shuffle partition, so this side is small by construction
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    numbered = numbered.withColumn(name, F.col("_offset") + place)
    if total is not None:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop("_id", "_part", "_offset", "_total")


def work_chunks(links: DataFrame, workers: int = WORKERS) -> DataFrame:
    """Position of each link and its contiguous chunk of size n // workers + 1."""
    numbered = number_rows(links, *LINK_ORDER, total="_links")
    size = F.floor(F.col("_links") / workers) + 1
    return numbered.withColumn("chunk", F.floor(F.col("position") / size)).drop("_links")


def cap_per_hotel(
    records: DataFrame,
    limit: int = MAX_REVIEWS_PER_HOTEL,
    order: tuple[str, ...] = ("page_no", "pos"),
    hotel: str = "hotel_url",
    buckets: int = _CAP_BUCKETS,
    broadcast_cuts: int = _BROADCAST_CUTS,
) -> DataFrame:
    """The first `limit` records of each hotel; `order` must be unique within a hotel.

    Only the order columns of hotels above the limit are ranked, to find where each of
    them is cut. A very large hotel is ranked in `buckets` parts first, of which each
    passes on `limit` rows at most, so no task ever holds a whole hotel. Texts are never
    sorted; they are filtered by the cut, one narrow row per large hotel. The cuts are
    stored and counted: few of them are broadcast and no text is shuffled; many meet the
    texts in salted parts, so that a giant hotel spreads over tasks.
    """
    place = F.struct(*order)
    large = records.groupBy(hotel).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    large = stage(large, "large-hotels")
    narrow = records.select(F.col(hotel), place.alias("_place"))
    # null-safe join: records without a hotel url form one group too
    narrow = narrow.join(large.select(F.col(hotel).alias("_h")), F.col(hotel).eqNullSafe(F.col("_h")), "left_semi")
    bucket = F.pmod(F.xxhash64("_place"), F.lit(buckets))
    in_bucket = F.row_number().over(Window.partitionBy(hotel, "_bucket").orderBy("_place"))
    head = (
        narrow.withColumn("_bucket", bucket).withColumn("_rank", in_bucket).where(F.col("_rank") <= limit)
    ).select(hotel, "_place")
    in_hotel = F.row_number().over(Window.partitionBy(hotel).orderBy("_place"))
    cuts = head.withColumn("_rank", in_hotel).where(F.col("_rank") == limit)
    cuts = stage(cuts.select(F.col(hotel).alias("_h"), F.col("_place").alias("_cut")), "cuts")
    same = F.col(hotel).eqNullSafe(F.col("_h"))
    if cuts.count() <= broadcast_cuts:
        kept = records.join(F.broadcast(cuts), same, "left")
    else:
        salted = cuts.withColumn("_cut_salt", F.explode(F.sequence(F.lit(0), F.lit(_CUT_SALTS - 1))))
        salt = F.pmod(F.xxhash64(place), F.lit(_CUT_SALTS)).cast("int")
        kept = records.withColumn("_salt", salt).join(salted, same & (F.col("_salt") == F.col("_cut_salt")), "left")
        kept = kept.drop("_salt", "_cut_salt")
    return kept.where(F.col("_cut").isNull() | (place <= F.col("_cut"))).drop("_h", "_cut")
