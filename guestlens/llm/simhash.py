"""SimHash near duplicates: fingerprints linked by BK-trees over shards."""

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.llm.common import keep_decided
from guestlens.llm.components import components
from guestlens.session import stage

# Largest number of fingerprints in one tree.
TREE_SIZE = 16_384
# Large shards whose sizes may be broadcast, 16 bytes each.
_BROADCAST_SHARDS = 1_000_000
# Pairs that one step of a search holds at most, about 16 bytes each.
_FRONTIER = 250_000


def fingerprint_udf(shingle_words: int, words64: int = 1):
    """Texts to hexadecimal SimHash fingerprints of 64 or 128 bits."""

    @F.pandas_udf("string")
    def fingerprint(texts):
        import numpy as np
        import pandas as pd
        import xxhash

        digest = xxhash.xxh64_digest if words64 == 1 else xxhash.xxh128_digest

        def one(text):
            # bytes lower() and split() know ASCII letters and ASCII white space only
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            if not words:
                return "0" * (16 * words64)
            rows = max(1, len(words) - shingle_words + 1)
            ones = np.zeros(64 * words64, dtype=np.int64)
            for at in range(0, rows, 4096):
                block = words[at : at + 4096 + shingle_words - 1]
                if len(block) <= shingle_words:
                    shingles = [b" ".join(block)]
                else:
                    shingles = map(b" ".join, zip(*(block[i:] for i in range(shingle_words))))
                hashes = b"".join([digest(s, 42) for s in shingles])
                bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64 * words64)
                ones += bits.sum(axis=0, dtype=np.int32)
            return np.packbits(ones * 2 > rows).tobytes().hex()

        return pd.Series([one(t) for t in texts], dtype="object")

    return fingerprint


def block_masks(blocks: int = 5, kept: int = 2) -> list[tuple[int]]:
    """Masks of every choice of `kept` out of `blocks` parts of 64 bits. Fingerprints
    that differ in at most blocks - kept bits agree under at least one mask."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [(sum(chosen),) for chosen in itertools.combinations(parts, kept)]


def _word(fingerprint: Column, at: int) -> Column:
    return F.conv(F.substring(fingerprint, 16 * at + 1, 16), 16, -10).cast("long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bk_forest(tree, values):
    """BK-trees, one per distinct number in `tree` (sorted), over rows of 64-bit words.

    Children are keyed by their integer Hamming distance to the parent. All trees grow
    together, a level a step: of the rows that went down the same edge the first becomes
    the node and the others go on from there. Returns the root of every row's tree and
    the edges as (parent * 256 + distance, child), sorted.
    """
    import numpy as np

    first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, dtype=np.int64)
    root = np.repeat(first, np.diff(np.r_[first, len(tree)]))
    rest = np.setdiff1d(np.arange(len(tree)), first, assume_unique=True)
    above = root[rest]
    keys, children = [], []
    while len(rest):
        apart = np.bitwise_count(values[rest] ^ values[above]).sum(axis=1, dtype=np.int64)
        edge, at, group = np.unique(above * 256 + apart, return_index=True, return_inverse=True)
        keys.append(edge)
        children.append(rest[at])
        above = rest[at][group]
        left = np.ones(len(rest), dtype=bool)
        left[at] = False
        rest, above = rest[left], above[left]
    key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
    child = np.concatenate(children) if children else np.zeros(0, dtype=np.int64)
    order = np.argsort(key)
    return root, key[order], child[order]


def bk_search(values, starts, queries, key, child, node_values, radius: int):
    """Yields (query, node) pairs within the radius. From a node at distance d only the
    edges d - radius to d + radius are followed."""
    import numpy as np

    query, node = np.arange(len(queries)), starts
    while len(query):
        apart = np.bitwise_count(queries[query] ^ node_values[node]).sum(axis=1, dtype=np.int64)
        near = apart <= radius
        yield query[near], node[near]
        low = np.searchsorted(key, node * 256 + np.maximum(apart - radius, 0))
        high = np.searchsorted(key, node * 256 + np.minimum(apart + radius, 255), side="right")
        count = high - low
        query = np.repeat(query, count)
        offset = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        node = child[np.repeat(low, count) + offset]


def _links_of(rows, radius: int, words64: int):
    """(a, b) fingerprints of a spanning forest of the links within each shard; `rows`
    is an Arrow table in order of its shards."""
    import numpy as np
    import pyarrow as pa

    shard = rows.column("shard").to_numpy()
    same = shard[1:] == shard[:-1]
    shared = np.r_[False, same] | np.r_[same, False]  # rows alone in their shard have no links
    values = np.stack([rows.column(f"w{i}").to_numpy()[shared] for i in range(words64)], axis=1).view(np.uint64)
    shard = np.cumsum(np.r_[False, shard[shared][1:] != shard[shared][:-1]]) if shared.any() else shard[shared]
    role = rows.column("role").to_numpy()[shared]
    # role 0: in the tree, 1: looks for neighbours, 2: both
    in_tree, asks = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    root, key, child = bk_forest(shard[in_tree], values[in_tree])
    start_of = np.full(shard.max(initial=-1) + 1, -1)
    start_of[shard[in_tree]] = root
    asks = asks[start_of[shard[asks]] >= 0]
    label = np.arange(len(shard))
    sizes = np.bincount(shard[in_tree], minlength=len(start_of))[shard[asks]]
    block = np.cumsum(sizes) // _FRONTIER
    for b in np.unique(block):
        now = asks[block == b]
        for query, node in bk_search(values[now], start_of[shard[now]], values[now], key, child, values[in_tree], radius):
            x, y = now[query], in_tree[node]
            while len(x):
                a, c = label[x], label[y]
                differ = a != c
                x, y, a, c = x[differ], y[differ], a[differ], c[differ]
                low = np.minimum(a, c)
                np.minimum.at(label, a, low)
                np.minimum.at(label, c, low)
                while True:
                    jumped = label[label]
                    if (jumped == label).all():
                        break
                    label = jumped
    linked = np.flatnonzero(label != np.arange(len(shard)))
    hexes = lambda rows: ["".join(f"{int(w):016x}" for w in r) for r in values[rows]]
    return pa.record_batch([pa.array(hexes(linked), "string"), pa.array(hexes(label[linked]), "string")], ["a", "b"])


def shard_links(prints: DataFrame, masks: list[tuple[int, ...]], radius: int, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect whatever is within the
    radius and agrees under a mask.

    The bits under each mask name a shard. A shard above `tree_size` is cut into parts
    by a hash, each part has its tree, and every part is searched in the trees of all
    parts of its shard, pair by pair, in tasks of their own. A task passes on a spanning
    forest, at most one link per fingerprint and shard, never all pairs.
    """
    words64 = len(masks[0])
    words = [f"w{i}" for i in range(words64)]
    prints = prints.select(*(_word(F.col("fingerprint"), i).alias(w) for i, w in enumerate(words)))
    shards = [
        F.xxhash64(F.lit(n), *(F.col(w).bitwiseAND(F.lit(_signed(m))) for w, m in zip(words, mask)))
        for n, mask in enumerate(masks)
    ]
    keyed = stage(prints.select(*words, F.explode(F.array(*shards)).alias("shard")), "shards")
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tree_size)
    sizes = stage(sizes, "large-shards")
    hint = F.broadcast if sizes.count() <= _BROADCAST_SHARDS else (lambda df: df)
    parts = F.coalesce(F.ceil(F.col("_n") / tree_size).cast("int"), F.lit(1))
    placed = keyed.join(hint(sizes), "shard", "left").withColumn("_parts", parts)
    placed = placed.withColumn("_part", F.pmod(F.xxhash64(*words), F.col("_parts")).cast("int"))
    # the pair (low, high) of parts: the low one grows the tree, the high one asks
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other")
    placed = placed.select("*", other)
    role = F.when(F.col("_part") == F.col("_other"), 2).when(F.col("_part") < F.col("_other"), 0).otherwise(1)
    pair = F.xxhash64("shard", F.least("_part", "_other"), F.greatest("_part", "_other"))
    tasks = placed.select(pair.alias("shard"), role.alias("role"), *words)
    tasks = tasks.repartition("shard").sortWithinPartitions("shard")

    def link(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            held = batch if held is None else pa.concat_tables([held, batch])
            if len(held) < 100_000:
                continue
            shard = held.column("shard").to_numpy()
            whole = int(np.argmax(shard == shard[-1]))  # all before the last shard
            if whole:
                yield _links_of(held.slice(0, whole), radius, words64)
                held = held.slice(whole)
        if held is not None and len(held):
            yield _links_of(held, radius, words64)

    return tasks.mapInArrow(link, "a string, b string")


def simhash_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = 3,
    radius: int = 3,
    masks: list[tuple[int, ...]] | None = None,
    tree_size: int = TREE_SIZE,
) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    The fingerprint has a bit set when more than half of the XXH64 values (seed 42) of
    the word shingles have it set; words stand between ASCII white space, A-Z lowered.
    Equal fingerprints are one node. Nodes are linked within the radius by BK-trees over
    shards, and the links are contracted to components in Spark. component_id is the
    smallest doc_id of the component.

    Null and empty texts have fingerprint zero and are linked like any other; a text
    shorter than a shingle is one shingle. Rows with a null doc_id take part, the smallest
    id ignores them (null when a component has no other). Repeated rows are rows of their
    own. An empty table gives no rows. Other columns are not looked at.
    """
    masks = masks or block_masks(radius + 2, 2)
    prints = fingerprint_udf(shingle_words, len(masks[0]))(F.col(text)).alias("fingerprint")
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), prints), "fingerprints")
    smallest = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("_first")), "distinct-fingerprints")
    return _labelled(rows, smallest, components(shard_links(smallest, masks, radius, tree_size)))


def _labelled(rows: DataFrame, smallest: DataFrame, roots: DataFrame) -> DataFrame:
    """`rows` (doc_id, fingerprint) with component_id, the smallest id of the component."""
    rooted = smallest.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = stage(rooted.withColumn("_root", F.coalesce("root", "fingerprint")).drop("root"), "rooted")
    # few: only components of several fingerprints
    joined = rooted.join(roots.select(F.col("root").alias("_root")).distinct(), "_root", "left_semi")
    joined = joined.groupBy("_root").agg(F.min("_first").alias("_joined"))
    ids = rooted.join(joined, "_root", "left")
    ids = ids.select("fingerprint", F.when(F.col("_joined").isNull(), F.col("_first")).otherwise(F.col("_joined")).alias("component_id"))
    return rows.join(stage(ids, "component-ids"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3, radius: int = 3) -> DataFrame:
    """The documents without near copies, with all their columns: of each component of
    `simhash_dedup` the document with the smallest doc_id stays.

    Null, empty and blank texts have the same fingerprint, zero, so one of them stays. Rows
    with a null id go unless their component has no other; of several rows with the staying
    id one stays per fingerprint. An empty table gives no rows.
    """
    found = simhash_dedup(docs, doc_id, text, shingle_words, radius)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    decided = found.select("doc_id", F.col("fingerprint").alias("key"), kept.alias("kept"))
    return keep_decided(docs, stage(decided, "near-kept"), doc_id, fingerprint_udf(shingle_words)(F.col(text)))
