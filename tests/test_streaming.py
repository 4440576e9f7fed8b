from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.operators import dedup
from guestlens.schema import RAW_COLUMNS
from guestlens.sources import readers, writers
from guestlens.streaming import ingest, trend


def raw(spark, rows):
    data = [(s, "h", "u", t, "8", "p", "n", "2024-01-05") for s, t in rows]
    return spark.createDataFrame(data, "seq long, " + ", ".join(f"{c} string" for c in RAW_COLUMNS)).coalesce(1)


def stored(spark, table):
    return sorted((r.seq, r.title) for r in readers.read_reviews(spark, table).collect())


def test_stream_ingest_and_replay(spark, tmp_path):
    source, table, csv = (str(tmp_path / n) for n in ("in", "out", "csv"))
    for rows in ([(1, "a"), (2, "b"), (3, "a")], [(0, "a"), (4, "c")], [(5, "c"), (6, "b")]):
        raw(spark, rows).write.mode("append").parquet(source)
    counts = {}
    query = ingest.start_ingest(
        ingest.read_batches(spark, source), table, str(tmp_path / "offsets"), csv, counts.__setitem__
    )
    query.awaitTermination()
    assert [tuple(counts[i].values()) for i in range(3)] == [(3, 0, 2), (2, 0, 1), (2, 0, 0)]
    expected = [(1, "a"), (2, "b"), (4, "c")]
    assert stored(spark, table) == expected
    written = [readers.read_review_csv(spark, f"{csv}/ingest_id={query.id}-{i}") for i in (0, 1)]
    assert [sorted(r.title for r in w.collect()) for w in written] == [["a", "b"], ["c"]]

    # a batch that ran but was not recorded runs again: its own rows are replaced
    own = f"{query.id}-1"
    ingest.ingest_batch(raw(spark, [(0, "a"), (4, "c")]), own, table)
    assert stored(spark, table) == expected
    # even when the second run finds fewer rows and months
    ingest.ingest_batch(raw(spark, [(0, "a"), (4, "c")]).withColumn("date", F.lit("2024-02-07")), own, table)
    assert stored(spark, table) == [(0, "a"), (1, "a"), (2, "b"), (4, "c")]
    ingest.ingest_batch(raw(spark, [(0, "a"), (4, "c")]), own, table)
    assert stored(spark, table) == expected
    # everything again under a new number adds nothing
    ingest.ingest_batch(raw(spark, [(7, "a"), (8, "b"), (9, "c")]), f"{query.id}-3", table)
    assert stored(spark, table) == expected

    # the stream goes on where it stopped
    raw(spark, [(10, "d"), (11, "a")]).write.mode("append").parquet(source)
    ingest.start_ingest(ingest.read_batches(spark, source), table, str(tmp_path / "offsets")).awaitTermination()
    assert [t for _, t in stored(spark, table)] == ["a", "b", "c", "d"]

    # with a fresh checkpoint all comes again, and what other ingests stored stays
    raw(spark, [(12, "e")]).write.mode("append").parquet(source)
    ingest.start_ingest(ingest.read_batches(spark, source, 2), table, str(tmp_path / "fresh")).awaitTermination()
    assert [t for _, t in stored(spark, table)] == ["a", "b", "c", "d", "e"]


def test_batch_run_and_stream_share_a_table(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    writers.append_reviews(dedup.with_hash(raw(spark, [(1, "a"), (2, "b")])), table)
    raw(spark, [(3, "b"), (4, "c")]).write.parquet(source)
    ingest.start_ingest(ingest.read_batches(spark, source), table, str(tmp_path / "o")).awaitTermination()
    writers.append_reviews(dedup.with_hash(raw(spark, [(5, "d")])), table)
    assert stored(spark, table) == [(1, "a"), (2, "b"), (4, "c"), (5, "d")]


def test_late_and_undated_reviews_are_kept_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    late = raw(spark, [(3, "old")]).withColumn("date", F.lit("2003-01-05"))
    undated = raw(spark, [(4, "when")]).withColumn("date", F.lit("soon"))
    for part in (raw(spark, [(1, "a")]), late, undated, late.unionByName(undated).coalesce(1)):
        part.write.mode("append").parquet(source)
    columns = T.StructType.fromDDL("title string, review_hash string")
    counts = {}
    stream = ingest.read_batches(spark, source)
    ingest.start_distinct(stream, out, str(tmp_path / "o"), columns, counts.__setitem__).awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(out).collect()) == ["a", "old", "when"]
    assert [tuple(c.values()) for _, c in sorted(counts.items())] == [(1, 0, 1), (1, 0, 1), (1, 1, 1), (2, 1, 0)]


def test_enrichment_is_stored_for_rows_not_done(spark, tmp_path):
    table, seen = str(tmp_path / "out"), []

    def enrich(rows):
        seen.append(sorted(r.title for r in rows.collect()))
        return rows.withColumns({"language": F.lit("xx"), "sentiment_score_pos": F.lit(0.5)})

    for rows in ([(1, "a"), (2, "b")], [(3, "c")]):
        writers.append_reviews(dedup.with_hash(raw(spark, rows)), table)
        assert writers.store_enrichment(spark, table, enrich) == len(rows)
    assert seen == [["a", "b"], ["c"]]
    assert {(r.language, r.sentiment_score_pos) for r in readers.read_reviews(spark, table).collect()} == {("xx", 0.5)}
    assert writers.store_enrichment(spark, table, enrich) == 0 and stored(spark, table) == [(1, "a"), (2, "b"), (3, "c")]


def test_stream_keeps_the_hashes_of_the_batch(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"t{i * 7 % 13}") for i in range(40)]
    for start in range(0, 40, 10):
        raw(spark, rows[start : start + 10]).write.mode("append").parquet(source)
    ingest.start_ingest(ingest.read_batches(spark, source), table, str(tmp_path / "o")).awaitTermination()
    batch = dedup.keep_first(dedup.with_hash(raw(spark, rows)), ["seq"])
    kept = readers.read_reviews(spark, table).select("review_hash")
    assert sorted(r[0] for r in kept.collect()) == sorted(r.review_hash for r in batch.collect())


def test_bounded_dedup(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = raw(spark, [(1, "a"), (2, "b"), (3, "a")]).withColumn("at", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,seq)"))
    frame.write.parquet(source)
    stream = dedup.with_hash(spark.readStream.schema(frame.schema).parquet(source))
    trend.write_append(trend.dedup_within(stream, "at", "10 days").select("title"), out, str(tmp_path / "o")).awaitTermination()
    assert sorted(r[0] for r in spark.read.schema("title string").parquet(out).collect()) == ["a", "b"]


def test_trend_follows_the_stream(spark, tmp_path):
    source, out, offsets = (str(tmp_path / n) for n in ("in", "out", "o"))
    schema = "at timestamp, v double"

    def send(*rows):
        spark.createDataFrame(rows, "d string, v double").select(F.col("d").cast("timestamp").alias("at"), "v").write.mode(
            "append"
        ).parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        trend.write_latest(trend.daily_trend(stream, "at", "v"), out, offsets).awaitTermination()
        daily = trend.read_latest(spark, out, "day date, n long, total double, n_valued long")
        return [(str(r.month), r.reviews, r.mean_value) for r in trend.monthly_from_daily(daily).collect()]

    assert send(("2024-01-01", 1.0), ("2024-01-31", 3.0)) == [("2024-01-31", 2, 2.0)]
    assert send(("2024-02-01", 5.0), ("2024-01-31", None)) == [("2024-01-31", 3, 2.0), ("2024-02-29", 1, 5.0)]
