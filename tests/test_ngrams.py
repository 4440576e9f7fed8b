import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from guestlens.checks import queries
from guestlens.operators import enrich, fitted, ngrams

GOOD = "clean quiet friendly wonderful tasty bright spacious helpful".split()
BAD = "dirty noisy rude awful stale dark cramped broken".split()


def reviews(rng, n):
    rows = []
    for i in range(n):
        kind = rng.randrange(3)
        words = [rng.choice([GOOD, BAD, GOOD + BAD][kind]) for _ in range(4)] + ["room", "staff", "breakfast", "the", "was"]
        rng.shuffle(words)
        label = ("POS", "NEG", "NEU")[kind]
        rows.append((i, " ".join(words), label if rng.random() < 0.9 else rng.choice(enrich.CLASSES)))
    return rows


def grams(text, lengths=ngrams.LENGTHS):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    for n in lengths:
        for i in range(len(data) - n + 1):
            key = 0
            for b in data[i : i + n]:
                key = (key * 257 + b + 1) % 2**64
            yield (((key + n) * 0x9E3779B97F4A7C15) % 2**64 >> 40) % ngrams.BUCKETS


TEXTS = ["", None, "a", "Ab", "abc", "één", "日本語", "x" * 3000, "the room was clean"]


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_counts_and_scores_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngrams, "_BLOCK", block)
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS * 3)] + [(99, "left out", None)]
    frame = spark.createDataFrame(rows, "id int, text string, label string").repartition(2)
    counts = {(r.label, r.bucket): r.n for r in ngrams.count_ngrams(frame).collect()}
    expected = {}
    for _, t, label in rows[:-1]:
        for b in grams(t):
            expected[label, b] = expected.get((label, b), 0) + 1
    assert counts == expected
    weights = np.random.default_rng(1).normal(size=(ngrams.BUCKETS, 3)).astype(np.float32)
    model = ngrams.NgramModel(("x", "y", "z"), weights)
    for r in ngrams.scores(frame, model, "text").collect():
        own = list(grams(r.text))
        assert r._scores == pytest.approx((weights[own].astype(float).sum(axis=0) / max(len(own), 1) ** 0.5).tolist(), abs=1e-3)


def test_language_of_unseen_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    found = queries.QUERIES["language_fitted"](spark, sf)
    right = found.where("lang is not null").agg(F.avg((F.col("lang") == F.col("language")).cast("double")), F.count(F.lit(1))).first()
    assert right[0] >= 0.99 and right[1] == spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").count()


def test_sentiment_of_unseen_reviews_is_calibrated(spark):
    rows = reviews(random.Random(5), 3000)
    frame = spark.createDataFrame(rows, "id int, text string, label string").repartition(4)
    found = ngrams.predict_unseen(frame, "id").collect()
    assert sum(r.label == r.predicted for r in found) / len(found) > 0.75  # a tenth of the labels is noise
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-6 for r in found)
    sure = [r for r in found if max(r.probabilities.values()) > 0.8]
    mean = sum(max(r.probabilities.values()) for r in sure) / len(sure)
    assert len(sure) > 300 and abs(sum(r.label == r.predicted for r in sure) / len(sure) - mean) < 0.08


def test_fitted_models_enrich(spark):
    rows = [(i, t, label) for i, t, label in reviews(random.Random(6), 800)]
    model = ngrams.fit(spark.createDataFrame(rows, "id int, text string, label string"))
    again = ngrams.NgramModel.from_frame(model.to_frame(spark))
    assert again.labels == model.labels and (again.weights == model.weights).all() and again.temperature == model.temperature
    languages = ngrams.fit(spark.createDataFrame([("en", "the room was clean and quiet"), ("es", "la habitación era limpia y tranquila")] * 20, "label string, text string"))
    given = [(1, "the staff was friendly wonderful helpful"), (2, "el personal era sucio"), (3, "a"), (4, None), (5, "12 34"), (6, "the dirty noisy awful room")]
    frame = spark.createDataFrame(given, "seq int, full_review_processed string")
    named = fitted.with_fitted_language(frame, languages)
    assert {r.seq: r.language for r in named.collect()} == {1: "en", 2: "es", 3: "unknown", 4: "unknown", 5: "unknown", 6: "en"}
    scored = {r.seq: r for r in fitted.with_fitted_sentiment(named, {"en": again}).collect()}
    assert scored[1].sentiment_label == "POS" and scored[6].sentiment_label == "NEG" and scored[6].sentiment_score_neg > 0.5
    for seq in (2, 3, 4, 5):
        assert scored[seq].sentiment_label is None and scored[seq].sentiment_score_pos == scored[seq].sentiment_score_neu == 0.0
    with pytest.raises(ValueError):
        ngrams.fit(frame.select("seq", F.lit(None).cast("string").alias("label"), F.lit("").alias("text")))
