"""What queries move and hold: plans and sizes of blocks, on rows of their own."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from guestlens.checks import derived, queries
from guestlens.functions import markup
from guestlens.operators import enrich, terms
from guestlens.sources import readers, table, writers
from guestlens.streaming import cap

FORM = "seq long, hotel_name string, hotel_url string, title string, score string, positive string, negative string, date string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_meet_their_events_unsorted(spark, sf, no_broadcast):
    plan = plan_of(derived.raw_reviews(spark, sf))
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan


def test_fitted_sentiment_makes_its_texts_once(spark, sf):
    assert "Join" not in plan_of(queries.QUERIES["sentiment_fitted"](spark, sf))


@pytest.mark.parametrize("block, most", [(1, 10), (300, 12), (1 << 20, 60)])
def test_findings_become_arrow_block_by_block(monkeypatch, block, most):
    page = '<div data-testid="review"><p data-testid="review-positive-text">é%d</p></div>'
    pages = pa.array([page % i for i in range(50)] + [None, ""] * 5)
    monkeypatch.setattr(markup, "_BLOCK", block, raising=False)
    made = list(markup._review_blocks.func(iter([pages, pages])))
    assert max(map(len, made)) == most
    found = [f for array in made for f in array.to_pylist()]
    assert [len(f["records"]) for f in found] == ([1] * 50 + [0] * 10) * 2
    assert found[67]["records"][0]["positive"] == "é7"


def test_pages_go_through_blocks_in_order(spark):
    page = '<div data-testid="review"><p data-testid="review-positive-text">%s</p></div>'
    rows = [(i, page % (str(i) * 2000) if i % 7 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "i int, html string").coalesce(1)
    found = frame.select("i", markup.review_blocks(F.col("html"))["records"]["positive"].alias("p")).collect()
    assert len(found) == 3000 and all(r.p == ([str(r.i) * 2000] if r.i % 7 else []) for r in found)


def test_a_language_model_gets_blocks_of_bounded_bytes(spark):
    def load():
        def predict(texts):
            assert len(texts) == 1 or sum(len(t.encode()) for t in texts) <= 1 << 20
            return ["es" if t.startswith("hola") else "en" for t in texts]

        return predict

    rows = [(i, None if i % 50 == 0 else "a" if i % 50 == 1 else ("hola " if i % 3 else "héllo ") * (300_000 if i == 7 else 2000)) for i in range(400)]
    frame = spark.createDataFrame(rows, "i int, full_review_processed string").coalesce(1)
    found = {r.i: r.language for r in enrich.with_model_language(frame, load).collect()}
    calls = [(r[0], "unknown" if r[1] is None or r[1] == "a" else "es" if r[0] % 3 else "en") for r in rows]
    assert found == dict(calls)


def test_a_batch_of_a_stream_passes_on_first_places_only(spark):
    rows = [(p, k, h, f"{h}-{p}-{k}") for h in ("a", None) for p in range(40) for k in range(50)] + [(0, 0, "a", "again"), (5, 0, "b", "alone")]
    frame = spark.createDataFrame(rows, "page_no long, pos long, hotel_url string, title string").orderBy(F.desc("pos"), "title").coalesce(1)
    found = cap._first_of_batches(frame, 7, ("page_no", "pos"), "hotel_url").collect()
    assert len(found) == 15  # one batch
    assert {(r.hotel_url, r.page_no, r.pos) for r in found} == {(h, 0, k) for h in ("a", None) for k in range(7)} | {("b", 5, 0)}


def test_stored_rows_are_changed_where_they_lie(spark, tmp_path, monkeypatch):
    path, write, seen = str(tmp_path / "t"), table.write, []
    rows = [(i, "h", "u", f"t{i}", "8", "p", "n", "2024-01-05" if i % 3 else "2024-03-31") for i in range(60)]
    assert writers.insert_new(spark.createDataFrame(rows, FORM), path)["newly_saved"] == 60

    def written(changed, *more, **named):
        seen.append(changed.hint("rebalance") if not named.get("gathered") else changed)
        return write(changed, *more, **named)

    monkeypatch.setattr(table, "write", written)
    enrich_half = lambda df: df.withColumn("language", F.when(F.col("seq") % 2 == 0, "xx"))
    assert writers.store_enrichment(spark, path, enrich_half) == 60
    assert writers.store_enrichment(spark, path, lambda df: df.withColumn("language", F.lit("yy"))) == 30
    assert all("Exchange" not in plan_of(df) for df in seen) and len(seen) == 2
    stored = readers.read_reviews(spark, path).collect()
    assert {r.seq: r.language for r in stored} == {i: "yy" if i % 2 else "xx" for i in range(60)} and len(stored) == 60


def test_new_rows_of_a_batch_are_chosen_without_their_texts(spark, tmp_path, monkeypatch):
    path, keep_first, seen = str(tmp_path / "t"), writers.keep_first, []
    monkeypatch.setattr(writers, "keep_first", lambda df, order: seen.append(df.columns) or keep_first(df, order))
    rows = [(s, "h", "u", t, "8", "p", "n", d) for s, t, d in ((5, "a", "2024-01-05"), (2, "a", "2024-01-05"), (2, "a", "2024-01-05"), (None, "b", "?"), (None, "b", "?"), (7, "b", "?"), (8, "c", None))]
    assert writers.insert_new(spark.createDataFrame(rows, FORM), path) == {"batch_size": 7, "undated": 2, "newly_saved": 3}
    assert writers.insert_new(spark.createDataFrame(rows + [(9, "h", "u", "d", "8", "p", "n", None)], FORM), path)["newly_saved"] == 1
    assert sorted((r.title, r.seq) for r in readers.read_reviews(spark, path).where("seq is not null").collect()) == [("a", 2), ("c", 8), ("d", 9)]
    assert seen and all("positive" not in columns for columns in seen)
    monkeypatch.setattr(writers, "SMALL_BATCH_BYTES", 0, raising=False)
    assert writers.insert_new(spark.createDataFrame(rows, FORM), str(tmp_path / "u"))["newly_saved"] == 3


def test_pairs_meet_their_words_unsorted(spark, no_broadcast):
    rows = [(f"lovely breakfast {i % 7}'s 12 rooms x{i % 30} ٣٤ room 5pm",) for i in range(200)]
    found = terms.collocations(spark.createDataFrame(rows, "text string"))
    plan = plan_of(found)
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    words = {w for r in found.collect() for w in (r.w1, r.w2)}
    assert {"lovely", "breakfast", "5pm"} <= words and not words & {"12", "٣٤", "3's"}
