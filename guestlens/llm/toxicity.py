"""Toxicity by a chain of linear classifiers."""

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.session import stage

# Categories ahead of the labelled one, each with the words that mark it in training.
# Common English abuse.
CATEGORIES = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser", "fool", "dumb", "imbecile"),
    "contempt": ("worthless", "pathetic", "disgusting", "trash", "scum", "garbage", "filth", "vermin"),
}
# Labelled documents a chain is fitted on at most, half of them toxic if there are as many.
TRAINING_ROWS = 2400
# Words and word beginnings kept as features: those most typical of some category, by so
# many standard errors at least, which chance does not reach among all words of a sample.
FEATURES = 250
TYPICAL = 6.0
BEGINNINGS = (4, 5, 6)
FOLDS = 3
PENALTY = 0.01
REJECTED = 0.5

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Chain:
    """Fitted chain: one row of weights per category, over an intercept, the features
    and the probabilities of the categories before it."""

    categories: list[str]
    features: dict[str, int]
    weights: list

    def present(self, words: set[str]) -> list[int]:
        """Numbers of the features that occur in a set of words."""
        features = self.features
        found = {features[w] for w in words & features.keys()}
        for n in BEGINNINGS:
            found.update(features[m] for m in {f"{w[:n]}*" for w in words if len(w) >= n} & features.keys())
        return sorted(found)

    def probabilities(self, present) -> list[float]:
        """Category by category; each model is given what the earlier ones found.
        `present`: numbers of the features that occur."""
        earlier: list[float] = []
        for w in self.weights:
            z = w[0] + sum(w[1 + i] for i in present)
            z += sum(p * c for p, c in zip(earlier, w[1 + len(self.features) :]))
            earlier.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return earlier


def fit_logistic(x, y, penalty: float = PENALTY):
    """Ridge logistic regression by Newton steps; the intercept, column 0, is free.
    With one class only, all weight is on the intercept."""
    import numpy as np

    n, width = x.shape
    w = np.zeros(width)
    if n == 0:
        w[0] = -30.0
        return w
    rate = (y.sum() + 0.5) / (n + 1)
    w[0] = np.log(rate / (1 - rate))
    if y.min() == y.max():
        return w
    ridge = np.full(width, penalty)
    ridge[0] = 1e-6
    loss = lambda v: np.logaddexp(0, -(2 * y - 1) * (x @ v)).sum() + 0.5 * (ridge * v * v).sum()
    best = loss(w)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while loss(w - size * step) > best and size > 1e-6:
            size /= 2
        now = loss(w - size * step)
        if best - now < 1e-5 * max(1.0, best):
            break
        w, best = w - size * step, now
    return w


def fit_chain(names: list[str], present: list[list[int]], labels: dict[str, list[int]], folds: int = FOLDS) -> Chain:
    """Chain over documents given as the numbers of the marks they have; `labels` by
    category in chain order.

    Of marks that occur in the same documents the first is kept. A later model is trained
    on the probabilities that models of the other folds gave a document for the earlier
    categories, so it learns how far they can be trusted on documents not seen. The
    models kept are fitted on all documents.
    """
    import numpy as np

    n = len(present)
    base = np.zeros((n, len(names)))
    for row, marks in enumerate(present):
        base[row, marks] = 1
    kept = list({base[:, i].tobytes(): i for i in reversed(range(len(names)))}.values())
    kept = sorted(kept)[:FEATURES]
    base = np.c_[np.ones(n), base[:, kept]]
    fold = np.arange(n) % folds
    earlier = np.zeros((n, 0))
    weights = []
    for row in labels.values():
        y = np.array(row, dtype=float)
        x = np.c_[base, earlier]
        weights.append([float(v) for v in fit_logistic(x, y)])
        held_out = np.zeros(n)
        for k in range(folds):
            w = fit_logistic(x[fold != k], y[fold != k])
            held_out[fold == k] = 1 / (1 + np.exp(-np.clip(x[fold == k] @ w, -30, 30)))
        earlier = np.c_[earlier, held_out]
    return Chain(list(labels), {names[i]: at for at, i in enumerate(kept)}, weights)


def _marks(words: Column) -> Column:
    """The distinct marks of an array of words: the words themselves and their beginnings;
    languages that inflect or compound show the same stem in many words."""

    def of(w: Column) -> Column:
        begins = [F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in BEGINNINGS]
        return F.array_compact(F.array(w, *begins))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def typical_marks(sample: DataFrame, categories: list[str]) -> list[str]:
    """Marks typical of some category, most typical first, whole words before beginnings,
    longer before shorter: a few times FEATURES at most.

    `sample` has `_words` and a column 0 or 1 per category. The documents with each mark
    are counted in Spark, with partial sums per task.
    """
    whole = sample.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in categories)).first()
    if not whole["n"]:
        return []
    seen = F.col("_seen")
    counted = sample.select(F.explode(_marks(F.col("_words"))).alias("mark"), *categories)
    counted = counted.groupBy("mark").agg(F.count(F.lit(1)).alias("_seen"), *(F.sum(c).alias(c) for c in categories))
    scores = []
    for c in categories:
        share = whole[c] / whole["n"]
        if 0 < share < 1:
            # by how many standard errors the share of positives with the mark is high
            scores.append((F.col(c) - seen * share) / F.sqrt(seen * (share * (1 - share))))
    if not scores:
        return []
    counted = counted.withColumn("_best", F.greatest(*scores) if len(scores) > 1 else scores[0])
    best = counted.where(F.col("_best") >= TYPICAL).orderBy(
        F.desc("_best"), F.col("mark").endswith("*"), F.desc(F.length("mark")), "mark"
    )
    return [row["mark"] for row in best.select("mark").limit(4 * FEATURES).collect()]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAINING_ROWS) -> Chain:
    """Chain fitted on a bounded sample of labelled documents, chosen by a hash of the
    id; of equal word sets one is taken. Only the numbers of the typical marks of the
    sample's documents reach the driver."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    known = known.where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1))
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    # labels of documents that are not here would take places of the sample
    known = stage(known.join(docs.select(F.col(doc_id).alias("_id")), "_id", "left_semi"), "known-labels")
    total = {row["_toxic"]: row["count"] for row in known.groupBy("_toxic").count().collect()}
    order = [F.xxhash64("_id"), F.col("_id")]
    half = known.where("_toxic = 1").orderBy(*order).limit(rows // 2)
    rest = known.where("_toxic = 0").orderBy(*order).limit(rows // 2)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    # at most `rows` rows on the broadcast side
    sample = texts.join(F.broadcast(half.unionByName(rest)), "_id").withColumn("_order", F.xxhash64("_id"))

    def tokens(batches):
        import pyarrow as pa

        for batch in batches:
            words = [sorted(words_of(t)) for t in batch.column("_text").to_pylist()]
            parts = [batch.column("_order"), batch.column("_toxic"), pa.array(words, pa.list_(pa.string()))]
            yield pa.record_batch(parts, ["_order", "_toxic", "_words"])

    found = sample.select("_text", "_toxic", "_order").mapInArrow(tokens, "_order long, _toxic int, _words array<string>")
    found = found.groupBy("_words").agg(F.min("_order").alias("_order"), F.min_by("_toxic", "_order").alias("toxic"))
    marked = {c: F.arrays_overlap("_words", F.array(*map(F.lit, marks))).cast("int") for c, marks in CATEGORIES.items()}
    found = stage(found.withColumns(marked), "training-sample")
    categories = [*CATEGORIES, "toxic"]
    names = typical_marks(found, categories)
    number = {name: i for i, name in enumerate(names)}
    have = F.array_intersect(_marks(F.col("_words")), F.array(*map(F.lit, names)).cast("array<string>"))
    documents = found.select("_order", have.alias("_have"), *categories).orderBy("_order", "_have").collect()
    present = [sorted(number[m] for m in row["_have"]) for row in documents]
    chain = fit_chain(names, present, {c: [row[c] for row in documents] for c in categories})
    toxic = sum(row["toxic"] for row in documents)
    if 0 < toxic < len(documents):
        # the sample holds more toxic documents than the corpus; the intercept allows for it
        chain.weights[-1][0] += math.log(total[1] / total[0] * (len(documents) - toxic) / toxic)
    return chain


def chain_udf(chain: Chain):
    """Column function: text to the probabilities of the chain's categories."""

    @F.pandas_udf("array<double>")
    def probabilities(texts):
        import pandas as pd

        return pd.Series([chain.probabilities(chain.present(words_of(t))) for t in texts], dtype="object")

    return probabilities


def score_toxicity(docs: DataFrame, chain: Chain, text: str = "text") -> Column:
    """Probabilities of the chain's categories, the last of them for "toxic"."""
    return chain_udf(chain)(F.col(text))


def find_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, p_<category> of each category, score, toxic.

    A classifier chain: linear models for the categories one after the other, each given
    the probabilities of those before it, the last one trained on the labels. The
    features are words and word beginnings that occur anywhere in the whole text; how often
    does not count, so a long text is not diluted. toxic is score >= 0.5.

    A null or empty text has no words and gets the intercepts. Labels that are null or of
    unknown documents are left out, of several for one document the largest counts.
    Without labelled documents nothing is toxic. Repeated rows are rows of their own. An
    empty table gives no rows. Other columns are not looked at.
    """
    chain = train(docs, labels, doc_id, text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), score_toxicity(docs, chain, text).alias("_p"))
    last = F.get("_p", F.lit(len(chain.categories) - 1))
    return scored.select(
        "doc_id",
        *(F.get("_p", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(chain.categories[:-1])),
        last.alias("score"),
        (last >= REJECTED).alias("toxic"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the chain does not reject, with all their columns."""
    chain = train(docs, labels, doc_id, text)
    p = score_toxicity(docs, chain, text)
    return docs.where(F.get(p, F.lit(len(chain.categories) - 1)) < REJECTED)
