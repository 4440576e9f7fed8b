"""Text classifiers over hashed character n-grams, fitted and applied by Spark.

A model is linear: each n-gram of a text, a few bytes of its UTF-8 form, names a row of a
weight table by its hash, and the rows are summed. Fitting is one aggregate: n-grams are
counted by label, and the weights are the logarithms of their smoothed shares (multinomial
naive Bayes). A second look, at texts left out of the counts, calibrates the probabilities.
Tasks work on the bytes of whole Arrow batches at a time, never text by text.
"""

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.session import stage

LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 16
# Occurrences that every n-gram is given beforehand, as a share of one.
SMOOTHING = 0.05
# Most labels of a model; a table of weights has BUCKETS rows for each.
MOST_LABELS = 256
# Bytes of text that a task works on at a time.
_BLOCK = 1 << 20
# Temperatures that calibration chooses from, and the part of the texts it is left.
_TEMPERATURES = [0.05 * 1.25**i for i in range(40)]
_LEFT_OUT = 5


@dataclass(frozen=True)
class NgramModel:
    """Weights of (bucket, label); probabilities are those of the scores times a temperature."""

    labels: tuple[str, ...]
    weights: np.ndarray
    lengths: tuple[int, ...] = LENGTHS
    temperature: float = 1.0

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The model as a small table, to be stored: bucket -1 holds what is no weight."""
        rows = [(b, self.weights[b].tolist()) for b in range(len(self.weights))]
        head = [(-1, [self.temperature, *map(float, self.lengths)])]
        names = [(-2 - i, [0.0], label) for i, label in enumerate(self.labels)]
        return spark.createDataFrame([(*r, None) for r in head + rows] + names, "bucket int, weights array<double>, label string")

    @staticmethod
    def from_frame(frame: DataFrame) -> "NgramModel":
        # BUCKETS rows and a few more
        rows = {r["bucket"]: r for r in frame.collect()}
        labels = tuple(rows[b]["label"] for b in sorted((b for b in rows if b < -1), reverse=True))
        temperature, *lengths = rows[-1]["weights"]
        weights = np.array([rows[b]["weights"] for b in range(max(rows) + 1)], dtype=np.float32)
        return NgramModel(labels, weights, tuple(int(n) for n in lengths), temperature)


def _blocks(texts):
    """(bytes, starts, ends, first row) of runs of texts of about `_BLOCK` bytes, out of an
    Arrow array of binary values; a longer text comes alone."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + texts.offset + 1)[texts.offset :]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _BLOCK, side="right")) - 1)
        base = offsets[row]
        yield data[base : offsets[end]], offsets[row:end] - base, offsets[row + 1 : end + 1] - base, row
        row = end


def _hashed(data, starts, ends, lengths, buckets):
    """For each length the buckets of the n-grams that lie within one text, and the places
    where they begin. A-Z are lowered."""
    data = data.astype(np.uint64)
    data = data + np.where((data >= 65) & (data <= 90), np.uint64(32), np.uint64(0))
    left = np.repeat(ends, ends - starts) - np.arange(len(data))  # bytes to the end of the text
    key = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, max(lengths) + 1):
        key = key[: len(data) - n + 1] if n > 1 else key
        if not len(key):
            return
        key = key * np.uint64(257) + data[n - 1 :] + np.uint64(1)
        if n in lengths:
            at = np.flatnonzero(left[: len(key)] >= n)
            mixed = (key[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(40)).astype(np.int64) % buckets, at


def part_of(key: Column, parts: int) -> Column:
    """A number below `parts` that depends on the key alone."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % parts


def _binary(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def count_ngrams(texts: DataFrame, lengths: tuple[int, ...] = LENGTHS, buckets: int = BUCKETS) -> DataFrame:
    """(label, bucket, n): how often the n-grams of each label's texts fall into a bucket.
    Counts are combined per batch and per task before the shuffle."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            labels, label_of = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for i, label in enumerate(labels):
                found = np.zeros(buckets, dtype=np.int64)
                for data, starts, ends, _ in _blocks(batch.column(1).filter(pa.array(label_of == i))):
                    for hashed, _ in _hashed(data, starts, ends, lengths, buckets):
                        found += np.bincount(hashed, minlength=buckets)
                used = np.flatnonzero(found)
                columns = [pa.array([str(label)] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(found[used], pa.int64())]
                yield pa.record_batch(columns, ["label", "bucket", "n"])

    given = texts.where(F.col("label").isNotNull()).select("label", _binary(F.col("text")).alias("text"))
    counted = given.mapInArrow(count, "label string, bucket long, n long")
    return counted.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, lengths: tuple[int, ...] = LENGTHS, buckets: int = BUCKETS) -> NgramModel:
    """A model of the labelled texts (label, text). Four in five of them, by a hash of the
    text, give the weights, the fifth the temperature. Rows without a label are left out;
    null texts are empty. All labels count alike, however many texts they have."""
    fifth = part_of(F.coalesce("text", F.lit("")), _LEFT_OUT) == 0
    counts = stage(count_ngrams(texts.where(~fifth), lengths, buckets), "ngram-counts")
    found = [r["label"] for r in counts.select("label").distinct().limit(MOST_LABELS + 1).collect()]
    if not 0 < len(found) <= MOST_LABELS:
        raise ValueError(f"{len(found)} labels; a model takes 1 to {MOST_LABELS}")
    labels = tuple(sorted(found))
    table = np.zeros((buckets, len(labels)))
    # at most `buckets` rows a label
    for label, bucket, n in counts.toPandas().itertuples(index=False):
        table[bucket, labels.index(label)] = n
    shares = (table + SMOOTHING) / (table + SMOOTHING).sum(axis=0)
    weights = np.log(shares)
    weights -= weights.mean(axis=1, keepdims=True)
    return calibrated(NgramModel(labels, weights.astype(np.float32), lengths), texts.where(fifth))


def scores(df: DataFrame, model: NgramModel, text: str, name: str = "_scores") -> DataFrame:
    """Adds the scores of the labels to a frame, in the order of the model's labels: the
    summed weights of the n-grams over the root of their number, so that long texts are
    surer than short ones, but not in proportion. Null texts score nothing."""
    weights, lengths, buckets, width = model.weights, model.lengths, len(model.weights), len(model.labels)

    @F.arrow_udf("array<float>")
    def score(texts):
        import pyarrow as pa

        sums = np.zeros((len(texts), width))
        grams = np.zeros(len(texts))
        for data, starts, ends, row in _blocks(texts):
            for hashed, at in _hashed(data, starts, ends, lengths, buckets):
                low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
                running = np.concatenate([np.zeros((1, width)), np.cumsum(weights[hashed], axis=0, dtype=np.float64)])
                sums[row : row + len(starts)] += running[high] - running[low]
                grams[row : row + len(starts)] += high - low
        found = (sums / np.sqrt(np.maximum(grams, 1))[:, None]).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * width, pa.int32()), pa.array(found.ravel()))

    return df.withColumn(name, score(_binary(F.col(text))))


def _exponents(found: Column, temperature: Column) -> Column:
    return F.transform(found, lambda s: F.exp((s - F.array_max(found)) * temperature))


def calibrated(model: NgramModel, texts: DataFrame) -> NgramModel:
    """The model with the temperature under which the labels of these texts, which it has
    not seen, are likeliest: one aggregate over a list of candidates."""
    known = F.array(*map(F.lit, model.labels))
    at = F.array_position(known, F.col("label")).cast("int")
    scored = scores(texts.where(F.col("label").isin(list(model.labels))).select("label", "text"), model, "text")
    scored = scored.select(at.alias("_at"), F.col("_scores").cast("array<double>").alias("_scores"))

    def loss(temperature: float) -> Column:
        powers = _exponents(F.col("_scores"), F.lit(temperature))
        whole = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
        own = (F.element_at("_scores", F.col("_at")) - F.array_max("_scores")) * temperature
        return F.avg(F.log(whole) - own)

    losses = scored.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(_TEMPERATURES))).first()
    if losses[0] is None:  # nothing to look at
        return model
    best = min(range(len(_TEMPERATURES)), key=lambda i: losses[i])
    return replace(model, temperature=_TEMPERATURES[best])


def predict(df: DataFrame, model: NgramModel, text: str, label: str = "label", probabilities: str | None = None) -> DataFrame:
    """Adds the likeliest label, the first in order among equals, and a map of the labels'
    probabilities if a name is given for it."""
    scored = scores(df, model, text)
    known = F.array(*map(F.lit, model.labels))
    best = F.array_position("_scores", F.array_max("_scores")).cast("int")
    columns = {label: F.element_at(known, best)}
    if probabilities is not None:
        powers = _exponents(F.col("_scores").cast("array<double>"), F.lit(model.temperature))
        whole = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
        columns[probabilities] = F.map_from_arrays(known, F.transform(powers, lambda p: p / whole))
    return scored.withColumns(columns).drop("_scores")


def predict_unseen(rows: DataFrame, key: str, folds: int = 2, **more) -> DataFrame:
    """Adds to labelled rows (label, text) what models say that have not seen them: each fold,
    by a hash of `key`, is predicted by a model of the others. Columns predicted and
    probabilities. The rows are read three times for every fold; stage them if they are dear."""
    fold = part_of(F.coalesce(F.col(key).cast("string"), F.lit("")), folds)
    parts = []
    for k in range(folds):
        model = fit(rows.where(fold != k).select("label", "text"), **more)
        parts.append(predict(rows.where(fold == k), model, "text", "predicted", "probabilities"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
