"""From captured pages to new rows of the review table, and the harvest plan."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.functions import markup
from guestlens.functions.scores import extract_score
from guestlens.functions.text import body_fallback
from guestlens.operators.dedup import keep_first, new_rows, with_hash
from guestlens.operators.workplan import (
    MAX_REVIEWS_PER_HOTEL,
    WORKERS,
    cap_per_hotel,
    harvest_hotel_links,
    limit_links,
    pending,
    work_chunks,
)
from guestlens.schema import require_columns
from guestlens.session import stage
from guestlens.sources.writers import stored_form


def with_hotel_name(pages: DataFrame, site_marker: str | None = None) -> DataFrame:
    named = pages.withColumn("_head", markup.name_texts(F.col("html")))
    name = markup.hotel_name(F.col("html"), F.col("_head"), site_marker)
    return named.withColumn("hotel_name", name).drop("_head")


def walked(pages: DataFrame) -> DataFrame:
    """The pages with what one walk finds in each: `_found`, the review elements read and the
    errors of others. Staged, it serves `records_of` and `rejects_of` both."""
    return pages.withColumn("_found", markup.review_blocks(F.col("html")))


def review_records(pages: DataFrame) -> DataFrame:
    """One raw review per distinct finished record of a page, with its place in the page.

    Records are finished first, so elements whose texts differ only in ways the record
    does not show count once. They are distinct within the page's array, without a
    shuffle. `pages` has page_id, url, page_no, hotel_name, html. Bad or empty pages and
    elements that fail give no rows; see `rejects`.
    """
    return records_of(walked(require_columns(pages, ["page_id", "page_no", "url", "hotel_name", "html"])))


def records_of(found: DataFrame) -> DataFrame:
    """As `review_records`, of walked pages."""

    def finished(block: Column) -> Column:
        return F.struct(
            block["title"].alias("title"),
            extract_score(block["score"]).alias("score"),
            body_fallback(block["positive"], block["negative"], block["body"]).alias("positive"),
            block["negative"].alias("negative"),
            block["date"].alias("date"),
        )

    records = F.array_distinct(F.transform("_found.records", finished))
    found = found.select(
        "page_id", "page_no", "hotel_name", F.col("url").alias("hotel_url"), F.posexplode(records).alias("pos", "_r")
    )
    return found.select("page_id", "page_no", "pos", "hotel_name", "hotel_url", "_r.*")


def rejects(pages: DataFrame) -> DataFrame:
    """(page_id, reason) of what gives no review: pages that are unread, failed or without
    any, and every single review element that failed; also pages whose head or links
    could not be read."""
    return rejects_of(walked(pages))


def rejects_of(found: DataFrame) -> DataFrame:
    """As `rejects`, of walked pages."""
    found = found.select(
        "page_id",
        "html",
        "_found",
        markup.head_texts(F.col("html"))["error"].alias("_head_error"),
        markup.hotel_hrefs(F.col("html"))["error"].alias("_link_error"),
    )
    page = (
        F.when(F.coalesce(F.col("html"), F.lit("")) == "", "empty_page")
        .when(F.col("_found.error").isNotNull(), F.col("_found.error"))
        .when((F.size("_found.records") == 0) & (F.size("_found.errors") == 0), "no_reviews")
    )
    blocks = F.transform("_found.errors", lambda e: F.concat(F.lit("block: "), e))
    parts = F.array_compact(
        F.array(page, F.concat(F.lit("head: "), "_head_error"), F.concat(F.lit("links: "), "_link_error"))
    )
    return found.select("page_id", F.explode(F.concat(parts, blocks)).alias("reason"))


def records_and_rejects(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`review_records` and `rejects` of the pages, whose review elements are walked once."""
    found = stage(walked(require_columns(pages, ["page_id", "page_no", "url", "hotel_name", "html"])), "walked")
    return records_of(found), rejects_of(found)


def ingest_pages(
    pages: DataFrame,
    existing: DataFrame,
    max_reviews: int = MAX_REVIEWS_PER_HOTEL,
    site_marker: str | None = None,
) -> DataFrame:
    """New rows for the review table from captured review pages.

    Extraction is staged: parsing a page is the dearest step, and the cap reads the
    records twice.
    """
    records = stage(review_records(with_hotel_name(pages, site_marker)), "records")
    capped = cap_per_hotel(records, max_reviews)
    first = keep_first(with_hash(capped), ["page_no", "page_id", "pos"])
    return stored_form(new_rows(first, existing))


def ingest_raw(raw: DataFrame, existing: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """New raw reviews with hash: first of each hash by seq, not yet in the table."""
    return new_rows(keep_first(with_hash(raw), ["seq"]), existing, batch_rows)


def work_plan(
    pages: DataFrame, processed: DataFrame, limit: int = 0, workers: int = WORKERS
) -> DataFrame:
    """Hotel links of the captured search pages still to visit, in order, assigned to workers."""
    links = harvest_hotel_links(pages)
    return work_chunks(limit_links(pending(links, processed), limit), workers)
