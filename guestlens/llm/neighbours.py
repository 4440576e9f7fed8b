"""Nearest neighbours by collision-counting hashing with virtual rehashing."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Single projections, and how many of them must collide before a vector is verified.
PROJECTIONS = 96
THRESHOLD = 58
# Vectors in one index on average; up to 65,535 places in the arrays are kept in 16 bits.
SHARD_VECTORS = 16_384
# Vectors of an index that are verified per query at least, besides the wanted number:
# a fixed number and a share of the index.
VERIFIED_LEAST = 400
VERIFIED_SHARE = 0.15
_SEED = 42
_QUERY_BLOCK = 32


class CollisionIndex:
    """Sorted arrays of single projections over one shard of vectors."""

    def __init__(self, ids, vectors, projections: int, threshold: int, share: float):
        import numpy as np

        self.ids, self.vectors, self.threshold, self.share = ids, vectors, threshold, share
        # one more coordinate makes all vectors equally long, so that the nearest by
        # distance are those with the largest inner product
        lengths = (vectors * vectors).sum(axis=1)
        filled = np.c_[vectors, np.sqrt(np.maximum(lengths.max() - lengths, 0.0))]
        self.lines = np.random.default_rng(_SEED).standard_normal((filled.shape[1], projections))
        places = (filled @ self.lines).T
        order = np.argsort(places, axis=1, kind="stable")
        self.sorted = np.take_along_axis(places, order, axis=1)
        # place of each vector in each sorted array
        self.kind = np.uint16 if len(ids) <= 65_535 else np.uint32
        self.place = np.empty(order.shape, dtype=self.kind)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=self.kind)[None, :], axis=1)
        # first window: what a few vectors of the shard would have needed, a little less
        self.width = float(np.sqrt(lengths.max())) / 64
        trials = vectors[:: max(1, len(ids) // 8)][:8]
        self.width = min(width for _, width in self.search(trials, 1)) / 1.2

    def search(self, queries, wanted: int):
        """For each query, the rows that collide with it on at least `threshold` lines,
        and the window width at which there were enough of them.

        Windows centred on the query have one width on all lines. They are widened in
        virtual rounds until the vectors above the threshold are enough, or until the
        windows hold everything.
        """
        import numpy as np

        n = len(self.ids)
        enough = min(n, wanted + VERIFIED_LEAST + int(np.ceil(self.share * n)))
        at = queries @ self.lines[:-1]
        open_, width, results = np.arange(len(queries)), self.width, [None] * len(queries)
        while len(open_):
            low = np.array([np.searchsorted(row, x) for row, x in zip(self.sorted, (at[open_] - width).T)])
            high = np.array([np.searchsorted(row, x, side="right") for row, x in zip(self.sorted, (at[open_] + width).T)])
            going = []
            for k, query in enumerate(open_):
                # below the low end the difference wraps around and is large
                first, span = low[:, k, None].astype(self.kind), high[:, k, None] - low[:, k, None]
                inside = (self.place - first) < span.astype(self.kind)
                over = np.flatnonzero(inside.sum(axis=0, dtype=np.int16) >= self.threshold)
                if len(over) >= enough or (span == n).all():
                    results[query] = (over, width)
                else:
                    going.append(query)
            open_, width = np.array(going, dtype=np.int64), width * 1.15
        return results

    def nearest(self, queries, query_ids, wanted: int):
        """(ids, scores) of the best verified vectors per query, ties to the smaller id."""
        import numpy as np

        answers = []
        for query, query_id, (found, _) in zip(queries, query_ids, self.search(queries, wanted + 1)):
            found = found[self.ids[found] != query_id]
            # a row-wise sum gives equal vectors equal scores wherever they stand
            scores = (self.vectors[found] * query).sum(axis=1)
            best = np.lexsort((self.ids[found], -scores))[:wanted]
            answers.append((self.ids[found][best], scores[best]))
        return answers


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, all finite."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def dealt(vectors: DataFrame, shards: int) -> DataFrame:
    """The vectors with their shard; repeated rows of one id spread over all shards."""
    shard = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards))
    return vectors.select(shard.alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")


def nearest_neighbours(
    vectors: DataFrame,
    wanted: int = 20,
    query_every: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    shard_vectors: int = SHARD_VECTORS,
    projections: int = PROJECTIONS,
    threshold: int = THRESHOLD,
    share: float = VERIFIED_SHARE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every query, nearest first.

    Queries are the vectors whose id is divisible by `query_every`. Vectors are dealt by
    a hash of id and row to shards of bounded size, each with its own index; every shard is
    sent the queries after its vectors and reads them as a stream, so that a task holds
    one index and one Arrow batch of queries. A shard passes on `wanted` rows a query,
    and the best of all shards remain. Every vector is indexed, and every shard answers
    every query; recall depends on the collision threshold alone.

    Vectors that are null, zero or hold null or non-finite components take no part, nor
    do rows without id or with another number of components than most have (of equally
    frequent numbers the larger). A repeated id is a candidate as often as it occurs, but never for the
    query of the same id. Ties go to the smaller vec_id. With fewer candidates than wanted
    all are returned. No vectors, no rows. Other columns are not looked at.
    """
    good = usable(vectors, vec_id, embedding)
    counted = good.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.agg(F.max(F.struct("n", "size")).alias("most")).first()["most"]
    good = good.where(F.size("v") == (counted["size"] if counted else 0))
    shards = max(1, -(-counted["n"] // shard_vectors)) if counted else 1
    indexed = dealt(good, shards)
    asked = good.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "v"])
    shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    asked = asked.select(shard, F.lit(1).alias("kind"), "vec_id", "v")
    both = indexed.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")

    def answer(batches):
        import numpy as np
        import pyarrow as pa

        shard, index, ids, parts = None, None, [], []
        for batch in batches:
            width = len(batch.column("v")[0]) if len(batch) else 0
            numbers = np.asarray(batch.column("v").flatten()).reshape(len(batch), width)
            keys, kinds = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            names = np.asarray(batch.column("vec_id"))
            for key in np.unique(keys):
                if key != shard:
                    shard, index, ids, parts = key, None, [], []
                here = keys == key
                built, asking = here & (kinds == 0), np.flatnonzero(here & (kinds == 1))
                if built.any():
                    ids.append(names[built])
                    parts.append(numbers[built])
                if not len(asking) or not ids:
                    continue
                if index is None:
                    index = CollisionIndex(np.concatenate(ids), np.concatenate(parts), projections, threshold, share)
                    parts = []
                for at in range(0, len(asking), _QUERY_BLOCK):
                    rows = asking[at : at + _QUERY_BLOCK]
                    found = index.nearest(numbers[rows], names[rows], wanted)
                    query = np.repeat(names[rows], [len(f[0]) for f in found])
                    columns = [query, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                    yield pa.record_batch([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(answer, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", best).where(F.col("rank") <= wanted)
    return ranked.select("query_id", "rank", "vec_id", "score")
