"""Frequent terms and two-word collocations.

Rows are tokenised where they are; the texts are never joined into one. So no word
pair spans two reviews.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestlens.functions.stopwords import stop_words
from guestlens.functions.text import TOKEN, tokens
from guestlens.session import stage

# Number of terms of a cloud, shortest total text for one, score from
# which a word pair counts as a collocation.
CLOUD_TERMS = 50
MIN_TEXT = 10
COLLOCATION_SCORE = 30.0

# Tokens that are no part of a cloud: pure numbers, with or without a final 's.
_NUMBER = r"^\p{Nd}+(?:'s)?$"


def text_gate(texts: DataFrame) -> DataFrame:
    """Length of the texts joined by single spaces, and whether it is enough for a cloud."""
    length = F.sum(F.length("text")) + F.count("text") - 1
    total = texts.agg(F.coalesce(length, F.lit(0)).alias("text_length"))
    return total.withColumn("enough", F.col("text_length") >= MIN_TEXT)


def without_stopwords(terms: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Drops stop words. The built-in list is a fixed set tested in place; a list given
    as a frame is of unknown size, so Spark chooses that join by its measured size."""
    if stop is None:
        return terms.where(~F.col("term").isin(sorted(stop_words())))
    return terms.join(stop.select("term"), "term", "left_anti")


def term_counts(texts: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(term, n) over all texts. Counts are combined per task before the shuffle, so a
    very frequent word is one row per task."""
    words = texts.select(F.explode(tokens(F.col("text"))).alias("term"))
    return without_stopwords(words, stop).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(counts: DataFrame, size: int = CLOUD_TERMS) -> DataFrame:
    """The `size` most frequent terms, ties by term, with weights relative to the first."""
    top = counts.orderBy(F.desc("n"), "term").limit(size)
    return top.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy()))


def _without_possessive(word: Column) -> Column:
    return F.when(word.endswith("'s"), F.substring(word, F.lit(1), F.length(word) - 2)).otherwise(word)


def _word_and_next_counts(texts: DataFrame, by: list[str]) -> DataFrame:
    """(by, w1, w2, n): every word with the word after it, null where that is a stop word or
    none. A word's own count is the sum over its rows, so one pass serves both."""
    stop = sorted(stop_words())
    found = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    # a token that begins with one of a to z is none, which is quicker to see
    number = lambda t: ((t < "a") | (t >= "{")) & t.rlike(_NUMBER)
    words = texts.select(*by, F.filter(found, lambda t: ~number(t)).alias("w"))
    nexts = F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = words.select(*by, F.inline(F.arrays_zip(F.col("w").alias("w1"), nexts.alias("w2"))).alias("w1", "w2"))
    pairs = pairs.select(*by, _without_possessive(F.col("w1")).alias("w1"), _without_possessive(F.col("w2")).alias("w2"))
    kept = pairs.where(~F.col("w1").isin(stop)).select(*by, "w1", F.when(~F.col("w2").isin(stop), F.col("w2")).alias("w2"))
    return kept.groupBy(*by, "w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def _stem(word: Column) -> Column:
    """Word without a plural s. A stem belongs to two words at most, itself and its plural."""
    plural = word.endswith("s") & ~word.endswith("ss")
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def _shown(stem: Column, has_singular: Column) -> Column:
    """A plural reads as its singular where that occurs, else as itself."""
    return F.when(has_singular, stem).otherwise(F.concat(stem, F.lit("s")))


def _weighted_log(k: Column, n: Column, x: Column) -> Column:
    floor = F.lit(1e-10)
    return F.log(F.greatest(x, floor)) * k + F.log(F.greatest(1 - x, floor)) * (n - k)


def collocation_score(pair: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of a word pair from its count, the counts of both
    words and the number of words; 0 when one word is all there is."""
    p = second / total
    p_after = pair / first
    p_else = (second - pair) / (total - first)
    ratio = (
        _weighted_log(pair, first, p)
        + _weighted_log(second - pair, total - first, p)
        - _weighted_log(pair, first, p_after)
        - _weighted_log(second - pair, total - first, p_else)
    )
    return F.when((total <= first) | (total <= second), F.lit(0.0)).otherwise(-2 * ratio)


def _collocation_parts(texts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Words as (by, stem, n, single) and scored pairs as (by, s1, s2, w1, w2, n, score).

    Plurals are merged by grouping on the stem, so the only joins bring the counts of
    both words to each pair. The words, of which there are far fewer, are hashed, so that
    pairs are not sorted. Both are empty where there is too little text for a cloud.
    All clouds, one for each value of `by` (a handful), come out of one pass.
    """
    counts = stage(_word_and_next_counts(texts, by), "term-counts")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"), F.sum(F.col("n") * F.length("w1")).alias("_letters"))
    totals = stage(totals, "term-totals")
    # counted words that are long enough prove that the texts are; only few need measuring
    if not totals.where(F.col("_letters") < MIN_TEXT).isEmpty():
        measured = texts.groupBy(*by).agg((F.sum(F.length("text")) + F.count("text") - 1).alias("_length"))
        enough = measured.where(F.col("_length") >= MIN_TEXT).drop("_length")
        counts = counts.join(F.broadcast(enough), by, "left_semi")  # one row per cloud
    words = counts.groupBy(*by, _stem(F.col("w1")).alias("stem")).agg(
        F.sum("n").alias("n"), F.max(F.col("w1") == _stem(F.col("w1"))).alias("single")
    )
    pairs = (
        counts.where(F.col("w2").isNotNull())
        .groupBy(*by, "w1", _stem(F.col("w2")).alias("s2"))
        .agg(F.sum("n").alias("n"), F.max(F.col("w2") == _stem(F.col("w2"))).alias("single2"))
        .withColumn("s1", _stem(F.col("w1")))
        .withColumn("w2", _shown(F.col("s2"), F.col("single2")))
    )
    first = words.select(*by, F.col("stem").alias("s1"), F.col("n").alias("n1"))
    second = words.select(*by, F.col("stem").alias("s2"), F.col("n").alias("n2"))
    paired = pairs.join(first.hint("shuffle_hash"), [*by, "s1"]).join(second.hint("shuffle_hash"), [*by, "s2"])
    # one row per cloud
    paired = paired.join(F.broadcast(totals.drop("_letters")), by)
    score = collocation_score(F.col("n"), F.col("n1"), F.col("n2"), F.col("_total").cast("double"))
    scored = paired.withColumn("score", score)
    return words, scored.where(F.col("score") > COLLOCATION_SCORE).select(*by, "s1", "s2", "w1", "w2", "n", "score")


def collocations(texts: DataFrame) -> DataFrame:
    """(w1, w2, n, score) of the word pairs that occur together far more than by chance."""
    return _collocation_parts(_one_cloud(texts), _ONE)[1].select("w1", "w2", "n", "score")


_ONE = ["_cloud"]


def _one_cloud(texts: DataFrame) -> DataFrame:
    return texts.select(F.lit(True).alias("_cloud"), "text")


def cloud_counts(texts: DataFrame) -> DataFrame:
    """(term, n) of words and collocations; words give up what their pairs take."""
    return clouds_counts(_one_cloud(texts), _ONE).select("term", "n")


def clouds_counts(texts: DataFrame, by: list[str]) -> DataFrame:
    """As `cloud_counts`, (by, term, n): a cloud for each value of the columns `by`, of which
    there are a handful."""
    words, pairs = _collocation_parts(texts, by)
    pairs = stage(pairs, "collocations")
    taken = pairs.select(*by, F.explode(F.array("s1", "s2")).alias("stem"), (-F.col("n")).alias("n"))
    left = (
        words.unionByName(taken.withColumn("single", F.lit(False)))
        .groupBy(*by, "stem")
        .agg(F.sum("n").alias("n"), F.max("single").alias("single"))
        .where(F.col("n") > 0)
        .select(*by, _shown(F.col("stem"), F.col("single")).alias("term"), "n")
    )
    return left.unionByName(pairs.select(*by, F.concat_ws(" ", "w1", "w2").alias("term"), "n"))
