import pytest


@pytest.fixture
def docs(spark):
    """docs(rows, clash): documents out of (doc_id, text[, source]) rows, over several
    partitions, with columns of names that operators use inside."""

    def make(rows, *clash):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        for name in clash:
            frame = frame.selectExpr("*", f"'mine' AS `{name}`")
        return frame.repartition(3)

    return make
