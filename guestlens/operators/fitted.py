"""Language and sentiment of reviews by fitted n-gram models."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestlens.operators.enrich import CLASSES, MIN_LANGUAGE_TEXT, UNKNOWN
from guestlens.operators.ngrams import NgramModel, predict


def with_fitted_language(df: DataFrame, model: NgramModel) -> DataFrame:
    """Language by a fitted n-gram model; short texts and those without letters read
    `unknown`."""
    text = F.col("full_review_processed")
    found = predict(df, model, "full_review_processed", "language")
    usable = (F.length(text) >= MIN_LANGUAGE_TEXT) & text.rlike(r"\p{L}")
    return found.withColumn("language", F.when(usable, F.col("language")).otherwise(UNKNOWN))


def with_fitted_sentiment(df: DataFrame, models: dict[str, NgramModel]) -> DataFrame:
    """Label and class probabilities by a fitted n-gram model per language; rows in other
    languages keep no label and zero scores. A class that a model does not know reads 0."""
    names = {f"sentiment_score_{c.lower()}": c for c in CLASSES}
    found = df.withColumns({"sentiment_label": F.lit(None).cast("string"), **{n: F.lit(0.0) for n in names}})
    for language, model in models.items():
        text = F.when(F.col("language") == language, F.col("full_review_processed"))
        scored = predict(found.withColumn("_text", text), model, "_text", "_label", "_probabilities").drop("_text")
        own = F.col("language") == language
        columns = {"sentiment_label": F.when(own, F.col("_label")).otherwise(F.col("sentiment_label"))}
        for name, of in names.items():
            value = F.coalesce(F.try_element_at("_probabilities", F.lit(of)), F.lit(0.0))
            columns[name] = F.when(own, value).otherwise(F.col(name))
        found = scored.withColumns(columns).drop("_label", "_probabilities")
    return found
