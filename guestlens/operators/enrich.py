"""Text, language and sentiment of each review.

Both built-in scorers work row by row on token arrays with set tests, so enrichment
needs no shuffle and also runs on streams. A model of the user's can replace either.
"""

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.functions.binding import bind
from guestlens.functions.text import clean_text, full_review_text, tokens
from guestlens.functions.worker import worker_cached

# Shortest text with a language, code of an undecided one, languages
# that get a sentiment, sentiment classes, rows per model call.
MIN_LANGUAGE_TEXT = 3
UNKNOWN = "unknown"
SCORED_LANGUAGES = ["es", "en"]
CLASSES = ["POS", "NEG", "NEU"]
BATCH_SIZE = 32
# Bytes of text that a language model is given at a time.
_BLOCK = 1 << 20

# Function words that vote for a language; words shared by two languages are in both.
LANGUAGE_PROFILES = {
    "de": "der die das und ist nicht mit von den dem zu ein eine für auf im des sich auch wir war".split(),
    "en": "the and of to in is that it for was on with be by as this are at from we you not have".split(),
    "es": "el la los las de que en un una por con del se para es al su lo más muy pero no".split(),
    "fr": "le la les de et des du un une est que qui dans pour pas au sur avec ne ce par nous très".split(),
}

# Polar words per language. A stand-in for a trained model: its labels obey the same
# contract but are not comparable with a model's.
SENTIMENT_LEXICON = {
    "en": (
        "good great excellent amazing wonderful perfect clean comfortable friendly helpful lovely nice".split(),
        "bad terrible awful horrible poor dirty noisy rude broken uncomfortable disappointing worst".split(),
    ),
    "es": (
        "bueno buena excelente increíble perfecto perfecta limpio limpia cómodo cómoda amable recomendable".split(),
        "malo mala terrible horrible pésimo pésima sucio sucia ruido ruidoso roto incómodo".split(),
    ),
}

Lexicon = dict[str, tuple[list[str], list[str]]]
Prediction = tuple[str, dict[str, float]]
LoadModel = Callable[[str], Callable[[list[str]], list[Prediction]]]


def with_processed_text(df: DataFrame) -> DataFrame:
    text = full_review_text(F.col("title"), F.col("positive"), F.col("negative"))
    return df.withColumn("full_review_processed", clean_text(text))


def _hits(words: Column, listed: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(listed)))


def language_of(text: Column, profiles: dict[str, list[str]] = LANGUAGE_PROFILES) -> Column:
    """Language with the most profile words in the text; ties go to the first code.

    `unknown` when the text is shorter than three characters or has no such word.
    """
    codes = sorted(profiles)

    def winner(votes: Column) -> Column:
        best = F.array_max(votes)
        first = F.get(F.array(*(F.lit(c) for c in codes)), (F.array_position(votes, best) - 1).cast("int"))
        return F.when(best > 0, first).otherwise(F.lit(UNKNOWN))

    def vote(t: Column) -> Column:
        won = bind(tokens(t), lambda w: bind(F.array(*(_hits(w, profiles[c]) for c in codes)), winner))
        return F.when(F.length(t) < MIN_LANGUAGE_TEXT, F.lit(UNKNOWN)).otherwise(won)

    return bind(text, vote)


def with_language(df: DataFrame, profiles: dict[str, list[str]] = LANGUAGE_PROFILES) -> DataFrame:
    return df.withColumn("language", language_of(F.col("full_review_processed"), profiles))


def _blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The texts of Arrow batches in runs of about `_BLOCK` bytes; a longer text comes alone.
    A worker makes Python texts of one run at a time."""
    for texts in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
        row = 0
        while row < len(texts):
            before = ends[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ends, before + _BLOCK, side="right")))
            yield texts.slice(row, end - row)
            row = end


def with_model_language(df: DataFrame, load_model: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """Language from a model, loaded once per worker process. Labels may carry a
    `__label__` prefix; short texts and failing calls read `unknown`."""
    key = uuid.uuid4().hex

    @F.arrow_udf("string")
    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = worker_cached(key, load_model)
        for block in _blocks(batches):
            texts = block.to_pylist()
            codes = [UNKNOWN] * len(texts)
            usable = [(at, t.replace("\n", " ")) for at, t in enumerate(texts) if len(t) >= MIN_LANGUAGE_TEXT]
            try:
                for (at, _), code in list(zip(usable, predict([t for _, t in usable]), strict=True)):
                    codes[at] = code
            except Exception:
                for at, text in usable:  # find the texts that fail
                    try:
                        codes[at] = predict([text])[0]
                    except Exception:
                        pass
            yield pa.array(codes, pa.string())

    label = detect(F.coalesce("full_review_processed", F.lit("")))
    return df.withColumn("language", F.regexp_replace(label, "__label__", ""))


def sentiment_of(text: Column, language: Column, lexicon: Lexicon = SENTIMENT_LEXICON) -> Column:
    """struct(label, pos, neg, neu) of a Spanish or English text, null for others.

    With p positive and n negative words: p, n and 1 over p + n + 1 for POS, NEG, NEU.
    The highest wins; ties go NEU, POS, NEG.
    """

    def result(count: Column) -> Column:
        p, n = count["p"], count["n"]
        whole = p + n + 1
        label = F.when((p <= 1) & (n <= 1), "NEU").when(p >= n, "POS").otherwise("NEG")
        return F.struct(
            label.alias("label"), (p / whole).alias("pos"), (n / whole).alias("neg"), (1 / whole).alias("neu")
        )

    def score(row: Column) -> Column:
        def hits(words: Column, side: int) -> Column:
            counts = {code: _hits(words, lexicon[code][side]) for code in SCORED_LANGUAGES}
            spanish, english = (F.when(row["language"] == code, counts[code]) for code in SCORED_LANGUAGES)
            return F.coalesce(spanish, english)

        counted = bind(
            tokens(row["text"]), lambda w: bind(F.struct(hits(w, 0).alias("p"), hits(w, 1).alias("n")), result)
        )
        return F.when(row["language"].isin(SCORED_LANGUAGES), counted)

    return bind(F.struct(text.alias("text"), language.alias("language")), score)


def with_lexicon_sentiment(df: DataFrame, lexicon: Lexicon = SENTIMENT_LEXICON) -> DataFrame:
    """Label and class probabilities from polar words; rows in other languages keep no
    label and zero scores."""
    found = df.withColumn("_found", sentiment_of(F.col("full_review_processed"), F.col("language"), lexicon))
    columns = {"sentiment_label": F.col("_found.label")}
    for name in CLASSES:
        columns[f"sentiment_score_{name.lower()}"] = F.coalesce(F.col(f"_found.{name.lower()}"), F.lit(0.0))
    return found.withColumns(columns).drop("_found")


def predict_in_batches(predict, texts: list[str], batch_size: int = BATCH_SIZE) -> list[Prediction]:
    """Predictions in the order of the texts, asked for `batch_size` at a time."""
    found: list[Prediction] = []
    for start in range(0, len(texts), batch_size):
        found.extend(predict(texts[start : start + batch_size]))
    return found


def with_model_sentiment(df: DataFrame, load_model: LoadModel, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Sentiment from a model per language, each loaded at most once per worker process.

    `load_model(language)` returns a function from texts to (label, probabilities);
    classes missing from the probabilities read 0. Only text and language are sent.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf("struct<label:string,probas:map<string,double>>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, languages in batches:
            labels: list[str | None] = [None] * len(texts)
            probas: list[dict | None] = [None] * len(texts)
            for code in SCORED_LANGUAGES:
                at = [i for i, found in enumerate(languages) if found == code]
                if not at:
                    continue
                predictions = predict_in_batches(
                    worker_cached((key, code), partial(load_model, code)), [texts.iloc[i] for i in at], batch_size
                )
                for i, (label, by_class) in zip(at, predictions, strict=True):
                    labels[i], probas[i] = label, by_class
            yield pd.DataFrame({"label": labels, "probas": probas})

    scored = F.col("language").isin(SCORED_LANGUAGES)
    predicted = df.withColumn("_model", score(F.when(scored, F.col("full_review_processed")), F.col("language")))
    columns = {"sentiment_label": F.col("_model.label")}
    for name in CLASSES:
        found = F.try_element_at("_model.probas", F.lit(name))
        columns[f"sentiment_score_{name.lower()}"] = F.coalesce(found, F.lit(0.0))
    return predicted.withColumns(columns).drop("_model")
