import datetime
import random

import pytest
from pyspark.sql import functions as F

from guestlens.operators import dedup, filters, metrics, workplan
from guestlens.plans import ingest
from guestlens.schema import RAW_COLUMNS, RAW_REVIEW, require_columns
from guestlens.sources import readers, writers

D = datetime.date


def raw(spark, rows):
    """Raw reviews from (seq, hotel, title) triples; the rest is fixed."""
    data = [(s, h, f"u/{h}", t, "8", "p", "n", "2024-01-05") for s, h, t in rows]
    return spark.createDataFrame(data, "seq long, " + ", ".join(f"{c} string" for c in RAW_COLUMNS))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- duplicates ---------------------------------------------------------------------


def test_keep_first_takes_smallest_seq_in_any_order(spark):
    rows = [(s, "h", f"t{s % 7}") for s in range(70)]
    random.Random(1).shuffle(rows)
    kept = dedup.keep_first(dedup.with_hash(raw(spark, rows).repartition(5)), ["seq"])
    assert sorted(r.seq for r in kept.collect()) == list(range(7))


def test_keep_first_prunes_before_the_shuffle(spark):
    plan = plan_of(dedup.keep_first(dedup.with_hash(raw(spark, [(1, "h", "t")])), ["seq"]))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


@pytest.mark.parametrize("batch_rows", [None, 3, 10**9])
def test_new_rows(spark, batch_rows):
    held = dedup.with_hash(raw(spark, [(1, "h", "a"), (2, "h", "b")]))
    batch = dedup.with_hash(raw(spark, [(3, "h", "b"), (4, "h", "c"), (5, "g", "a")]))
    assert sorted(r.seq for r in dedup.new_rows(batch, held, batch_rows).collect()) == [4, 5]


def test_small_batch_never_shuffles_the_table(spark):
    held = dedup.with_hash(raw(spark, [(1, "h", "a")]))
    plan = plan_of(dedup.new_rows(dedup.with_hash(raw(spark, [(2, "h", "b")])), held, 1))
    assert "BroadcastHashJoin [review_hash" in plan and "CartesianProduct" not in plan


def test_bucketed_table_is_not_shuffled(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.sql(f"create database if not exists bucketed location '{tmp_path}'")
        held = writers.stored_form(dedup.with_hash(raw(spark, [(1, "h", "a")])))
        writers.save_bucketed(held, "bucketed.reviews", 8)
        batch = dedup.with_hash(raw(spark, [(2, "h", "b"), (3, "h", "a")]))
        new = dedup.new_rows(batch, spark.table("bucketed.reviews"))
        assert plan_of(new).count("Exchange hashpartitioning") == 1
        assert [r.seq for r in new.collect()] == [2]
    finally:
        spark.sql("drop database if exists bucketed cascade")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ingesting_twice_adds_nothing(spark, tmp_path):
    table, csv = str(tmp_path / "t"), str(tmp_path / "c")
    writers.create_table(spark, table)
    batch = raw(spark, [(1, "h", "a"), (2, "h", "a"), (3, "h", "b")]).withColumn("score", F.lit("Score: 85"))
    for _ in range(2):
        writers.append_reviews(ingest.ingest_raw(batch, readers.read_reviews(spark, table)), table, csv)
    stored = readers.read_reviews(spark, table).collect()
    assert sorted((r.seq, r.score, r.review_date, r.sentiment_label, r.sentiment_score_pos) for r in stored) == [
        (1, 8.5, D(2024, 1, 5), None, 0.0),
        (3, 8.5, D(2024, 1, 5), None, 0.0),
    ]
    # the CSV keeps the score as it came
    assert [r.score for r in readers.read_review_csv(spark, csv).collect()] == ["Score: 85"] * 2


def test_date_filter_reaches_the_scan(spark, tmp_path):
    writers.append_reviews(dedup.with_hash(raw(spark, [(1, "h", "a")])), str(tmp_path / "t"))
    table = readers.read_reviews(spark, str(tmp_path / "t"))
    chosen = filters.filter_dates(filters.filter_hotel(filters.prepare(table), "h"), D(2024, 1, 1), D(2024, 2, 1))
    plan = chosen.select("score")._jdf.queryExecution().executedPlan().collectLeaves().head().verboseStringWithOperatorId()
    assert "GreaterThanOrEqual(review_" in plan and "EqualTo(hotel_name,h)" in plan
    assert "ReadSchema: struct<hotel_name:string,score:double,review_date:date>" in plan
    assert "PartitionFilters: [isnotnull(review_month" in plan


def test_table_is_partitioned_by_month(spark, tmp_path):
    rows = raw(spark, [(1, "h", "a"), (2, "h", "b"), (3, "h", "c")])
    dates = F.when(F.col("seq") == 1, "2024-01-05").when(F.col("seq") == 2, "2024-03-31").otherwise("nope")
    writers.append_reviews(dedup.with_hash(rows.withColumn("date", dates)), str(tmp_path / "t"))
    table = readers.read_reviews(spark, str(tmp_path / "t"))
    assert {r.seq: r.review_month for r in table.collect()} == {1: D(2024, 1, 1), 2: D(2024, 3, 1), 3: None}
    assert [r.seq for r in filters.filter_dates(table, D(2024, 3, 31), D(2024, 4, 2)).collect()] == [2]
    chosen = {m: [r.seq for r in filters.filter_months(table, m).collect()] for m in ((D(2024, 1, 1),), (None,), ())}
    assert chosen == {(D(2024, 1, 1),): [1], (None,): [3], (): []}
    assert sorted(r.seq for r in filters.filter_months(table, (None, D(2024, 3, 1))).collect()) == [2, 3]


def test_exact_distinct_and_stats(spark):
    rows = [("a", None), ("a", None), ("a", ""), ("b", "x")]
    frame = spark.createDataFrame(rows, "a string, b string")
    assert dedup.duplicate_stats(frame).first() == (4, 3, 1)
    assert dedup.distinct_records(frame).count() == 3
    kept, removed = writers.rewrite_distinct(frame)
    assert removed == 1 and sorted(kept.collect(), key=str) == sorted([("a", None), ("a", ""), ("b", "x")], key=str)
    same, none = writers.rewrite_distinct(kept)
    assert none == 0 and same is kept
    assert dedup.duplicate_stats(frame.where("false")).first() == (0, 0, 0)


def test_batch_stats(spark):
    held = dedup.with_hash(raw(spark, [(1, "h", "a")]))
    batch = dedup.with_hash(raw(spark, [(2, "h", "a"), (3, "h", "b"), (4, "h", "b"), (5, "h", "c")]))
    assert dedup.batch_stats(batch, held).first() == (4, 2)
    assert dedup.batch_stats(batch.where("false"), held).first() == (0, 0)


def test_page_distinct(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "a"), (1, 3, None), (1, 4, None)]
    frame = spark.createDataFrame(rows, "page_id long, pos long, title string")
    for c in RAW_COLUMNS:
        frame = frame if c == "title" else frame.withColumn(c, F.lit("x"))
    got = sorted((r.page_id, r.pos) for r in dedup.page_distinct(frame).collect())
    assert got == [(1, 0), (1, 1), (1, 3), (2, 0)]


# --- work plan ----------------------------------------------------------------------


@pytest.mark.parametrize("limit, buckets", [(3, 4), (40, 2), (1000, 1024)])
def test_cap_against_brute_force(spark, limit, buckets):
    """One hotel holds most records, one has no url, others are small."""
    rng = random.Random(limit)
    rows = [(rng.choice(["big"] * 6 + [None, "b", "c"]), i // 10, i % 10) for i in range(600)]
    frame = spark.createDataFrame(rows, "hotel_url string, page_no long, pos long").repartition(7)
    expected, seen = [], {}
    for row in sorted(rows, key=lambda r: r[1:]):
        seen[row[0]] = seen.get(row[0], 0) + 1
        if seen[row[0]] <= limit:
            expected.append(row)
    got = [tuple(r) for r in workplan.cap_per_hotel(frame, limit, buckets=buckets).collect()]
    salted = workplan.cap_per_hotel(frame, limit, buckets=buckets, broadcast_cuts=-1)
    assert sorted(got, key=str) == sorted((tuple(r) for r in salted.collect()), key=str)
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_pending_keeps_null_and_duplicate_links(spark):
    links = spark.createDataFrame(
        [("a", 0, 0), ("b", 0, 1), (None, 0, 2), ("b", 0, 3), ("c", 1, 0)], "url string, first_page long, first_place int"
    )
    done = spark.createDataFrame([("a",), (None,), ("a",)], "url string")
    got = sorted((r.first_page, r.first_place) for r in workplan.pending(links, done).collect())
    assert got == [(0, 1), (0, 2), (0, 3), (1, 0)]
    assert workplan.pending(links, done.where("false")).count() == 5


def test_limit_links(spark):
    links = spark.range(10).select(
        F.concat(F.lit("u"), "id").alias("url"), (9 - F.col("id")).alias("first_page"), F.lit(0).alias("first_place")
    )
    assert sorted(r.first_page for r in workplan.limit_links(links, 3).collect()) == [0, 1, 2]
    assert workplan.limit_links(links, 0).count() == 10


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16, 1000])
def test_work_chunks(spark, n):
    place = F.col("id") * 7 % 1009
    links = spark.range(n).select(
        F.lit("u").alias("url"), F.floor(place / 10).alias("first_page"), (place % 10).alias("first_place")
    )
    got = workplan.work_chunks(links, 8).orderBy("first_page", "first_place").collect()
    size = n // 8 + 1
    assert [(r.position, r.chunk) for r in got] == [(i, i // size) for i in range(n)]


# --- filters and metrics ------------------------------------------------------------


def prepared(spark, rows):
    return spark.createDataFrame(rows, "hotel_name string, review_date date, score double, compound_score double, sentiment_label string")


ROWS = [
    ("a", D(2024, 1, 31), 8.0, 0.5, "POS"),
    ("a", D(2024, 1, 1), None, None, "NEG"),
    ("b", D(2024, 4, 30), 4.0, -0.5, "POS"),
    (None, D(2024, 4, 1), 6.0, 0.9, None),
]


def test_months(spark):
    frame = prepared(spark, ROWS)
    assert [tuple(r) for r in metrics.monthly_volume(frame).collect()] == [
        (D(2024, 1, 31), 2), (D(2024, 2, 29), 0), (D(2024, 3, 31), 0), (D(2024, 4, 30), 2),
    ]
    got = [tuple(r) for r in metrics.monthly_sentiment(frame).collect()]
    assert got == [(D(2024, 1, 31), 0.5), (D(2024, 4, 30), pytest.approx(0.2))]
    assert metrics.monthly_volume(frame.where("false")).collect() == []


def test_kpis_and_lists(spark):
    frame = prepared(spark, ROWS)
    assert metrics.kpis(frame).first() == (4, pytest.approx(0.3), pytest.approx(6.0))
    assert metrics.kpis(frame.where("false")).collect() == []
    assert [r[0] for r in metrics.hotel_list(frame).collect()] == ["None", "a", "b"]
    assert metrics.date_bounds(frame).first() == (D(2024, 1, 1), D(2024, 4, 30))
    assert [tuple(r) for r in metrics.sentiment_distribution(frame).collect()] == [
        ("POS", 2, pytest.approx(2 / 3)), ("NEG", 1, pytest.approx(1 / 3)),
    ]


def test_ranking_order_and_size(spark):
    rows = [(f"h{i:02}", D(2024, 1, 1), 5.0, float(i // 2), "POS") for i in range(14)] + [(None, D(2024, 1, 1), 5.0, 99.0, "POS")]
    got = [r.hotel_name for r in metrics.hotel_ranking(prepared(spark, rows)).collect()]
    assert got == ["h05", "h04", "h07", "h06", "h09", "h08", "h11", "h10", "h13", "h12"]


def test_filters(spark):
    frame = prepared(spark, ROWS)
    assert filters.filter_hotel(frame, "Todos").count() == 4
    assert filters.filter_hotel(frame, "a").count() == 2
    assert filters.filter_dates(frame, D(2024, 1, 31), D(2024, 4, 1)).count() == 2
    assert filters.filter_dates(frame, D(2024, 1, 31), None).count() == 4


def test_prepare_by_present_columns(spark):
    frame = spark.createDataFrame([("2024-01-01", "12,5"), ("nope", "3"), ("2024-01-02", None)], "date string, score string")
    got = {r.date: (r.score, r.compound_score) for r in filters.prepare(frame).collect()}
    assert got == {"2024-01-01": (1.25, -0.75), "2024-01-02": (None, 0.0)}
    assert filters.prepare(frame.drop("score")).first().compound_score == 0.0
    scored = frame.withColumns({"sentiment_score_pos": F.lit(0.7), "sentiment_score_neg": F.lit(0.1)})
    assert filters.prepare(scored).first().compound_score == pytest.approx(0.6)
    assert filters.prepare(frame.drop("date")).count() == 3


def test_corpus(spark):
    rows = [("t", "x", "POS", "p"), (None, "y", "POS", None), ("t", "z", "NEG", "q")]
    frame = spark.createDataFrame(rows, "title string, full_review_processed string, sentiment_label string, positive string")
    assert sorted(r.text for r in filters.corpus(frame, "positive", "POS").collect()) == ["p", "q"]
    assert sorted(r.text for r in filters.corpus(frame.drop("positive"), "positive", "POS").collect()) == ["None y", "t x"]
    assert filters.corpus(frame.select("title"), "positive", "POS").count() == 0


def test_empty_bodies(spark):
    frame = spark.createDataFrame([(None, None), ("", None), (" ", ""), ("p", "n")], "positive string, negative string")
    assert metrics.empty_body_audit(frame).first() == (4, 2, 2)


# --- sources and sinks --------------------------------------------------------------


def test_csv_keeps_text(spark, tmp_path):
    hard = [' edge "quoted", comma\nline\r\nend ', "tab\tñ\\n", "'", '""']
    rows = [("h", "u", t, "8", t, None, "d") for t in hard]
    frame = spark.createDataFrame(rows, RAW_REVIEW)
    writers.write_review_csv(frame, str(tmp_path / "c"))
    got = readers.read_review_csv(spark, str(tmp_path / "c")).collect()
    assert sorted(r.title for r in got) == sorted(hard)
    assert {r.negative for r in got} == {None}
    # no rows: the old export stays
    writers.write_review_csv(frame.where("false"), str(tmp_path / "c"))
    assert readers.read_review_csv(spark, str(tmp_path / "c")).count() == 4


def test_csv_sources_that_lack_something(spark, tmp_path):
    assert readers.read_review_csv(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.csv").write_text("title,x\nt,1\n")
    (tmp_path / "swapped.csv").write_text("title,hotel_url\nt,u\nt,u\n")
    for name in ("none", "empty.csv", "other.csv"):
        assert readers.processed_from_csv(spark, str(tmp_path / name)).count() == 0
    assert [r.url for r in readers.processed_from_csv(spark, str(tmp_path / "swapped.csv")).collect()] == ["u"]


def test_fallback_chain(spark, tmp_path):
    table, csv = str(tmp_path / "t"), str(tmp_path / "c")
    assert readers.reviews_or_fallback(spark, table, csv).count() == 0
    writers.write_review_csv(raw(spark, [(1, "h", "a")]), csv)
    assert "review_hash" not in readers.reviews_or_fallback(spark, table, csv).columns
    writers.create_table(spark, table)
    assert "review_hash" not in readers.reviews_or_fallback(spark, table, csv).columns
    writers.append_reviews(dedup.with_hash(raw(spark, [(1, "h", "a")])), table)
    assert "review_hash" in readers.reviews_or_fallback(spark, table, csv).columns


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>\nx</p>")
    page = readers.read_page_files(spark, str(tmp_path)).first()
    assert page.html == "<p>\nx</p>" and page.url.endswith("a.html")


def test_require_columns(spark):
    with pytest.raises(ValueError, match="hotel_url"):
        require_columns(spark.range(1), ["id", "hotel_url"])
