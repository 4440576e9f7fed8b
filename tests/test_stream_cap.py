import random

import pytest

from guestlens.operators.workplan import cap_per_hotel
from guestlens.streaming import cap

FORM = "page_no long, pos long, hotel_url string, title string"


@pytest.mark.parametrize("parts", [1, 4])
def test_the_cap_does_not_depend_on_the_batches(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(p, k, h, f"{h}-{p}-{k}") for h, pages in (("a", 9), ("b", 1), ("c", 4), (None, 5)) for p in range(pages) for k in range(5)]
    rng.shuffle(rows)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], FORM).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(FORM).option("maxFilesPerTrigger", 1).parquet(source)
    cap.start_capped(stream, out, str(tmp_path / "o"), limit=12).awaitTermination()
    changes = spark.read.schema("hotel_url string, page_no long, pos long, title string, out boolean").parquet(out)
    got = sorted((tuple(r) for r in cap.after_changes(changes).select("page_no", "pos", "hotel_url", "title").collect()), key=str)
    expected = cap_per_hotel(spark.createDataFrame(rows, FORM), 12)
    assert got == sorted((tuple(r) for r in expected.collect()), key=str) and len(got) == 12 + 5 + 12 + 12
    pushed = changes.where("out").count()
    assert (pushed == 0) == (parts == 1)

    # the stream goes on, and what came before stays out
    spark.createDataFrame([(0, -1, "a", "first of all"), (99, 0, "a", "last"), (0, 0, "a", "again")], FORM).write.mode("append").parquet(source)
    cap.start_capped(stream, out, str(tmp_path / "o"), limit=12).awaitTermination()
    left = cap.after_changes(spark.read.schema(changes.schema).parquet(out))
    titles = {r.title for r in left.where("hotel_url = 'a'").collect()}
    assert "first of all" in titles and not titles & {"last", "again"} and len(titles) == 12
