import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from guestlens.llm import mixing, queries


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets of sources by plain rounds; `sizes` by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        given, left_now = left, 0.0
        for s in sorted(open_, key=str):
            target[s] += given * weight[s] / whole
            if target[s] > cap * sizes[s]:
                left_now += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
        open_ = {s for s in open_ if target[s] < cap * sizes[s] - 1e-9}
        left = left_now
    return target


def words(text):
    return len((text or "").encode().split())


def check(rows, got, names):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    targets = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r[names["size"]] == words(r.text) and r[names["source_size"]] == sizes[r.source]
        assert r[names["target"]] == pytest.approx(targets[r.source])
        assert 0 <= r[names["copies"]] <= 2
        taken[r.source] += r[names["copies"]] * r[names["size"]]
    for s in sizes:
        smallest = min((words(t) for _, t, x in rows if x == s and words(t)), default=0)
        assert abs(taken[s] - targets[s]) <= max(smallest, 1), s


def test_against_brute_force(docs):
    rng = random.Random(1)
    names = ["b", "B", "ä", "", None, "😀", "\uffff", "a"]
    rows = [(i, "w " * rng.choice([1, 2, 3, 10, 200, 5000]), names[0] if i % 3 else rng.choice(names)) for i in range(600)]
    rows += [(i, "the same text", "copies") for i in range(600, 900)] + [(900, None, "empty"), (901, "", "empty"), (None, "x y", "a"), (5, "x", "b"), (5, "x", "b")]
    mixed, given = mixing.mix_sources(docs(rows, "size", "Target", "_key", "copies_"))
    got = mixed.collect()
    assert len(got) == len(rows) and given["size"] == "size_" and given["target"] == "target_"
    check(rows, got, given)
    again = mixing.mix_sources(docs(rows[::-1]))[0]
    count = lambda found: sorted((str(r.doc_id), r.text or "", r[-1]) for r in found)
    assert count(got) == count(again.collect())
    repeated = mixing.repeat_by_copies(docs(rows, "copies"))
    assert repeated.count() == sum(r[-1] for r in got) and repeated.columns[-1] == "copies"


def test_one_source_and_none(docs):
    rows = [(i, "w " * (i + 1), "only") for i in range(20)]
    mixed, names = mixing.mix_sources(docs(rows))
    check(rows, mixed.collect(), names)
    assert mixing.mix_sources(docs([]).where("false"))[0].count() == 0
    empty = mixing.mix_sources(docs([(1, None, None), (2, " ", None)]))[0].collect()
    assert [r.copies for r in empty] == [1, 1] and {r.target for r in empty} == {0.0}


def solved(sizes, target, cap=2):
    """Tilted rates by bisection, over single documents."""
    sizes = np.array(sizes, dtype=float)
    low, high = -50.0, 1.0
    for _ in range(200):
        tilt = (low + high) / 2
        rates = np.minimum(cap, np.exp(np.minimum(tilt * sizes, 5)))
        low, high = (tilt, high) if (rates * sizes).sum() < target else (low, tilt)
    return rates


def test_rates_meet_an_independent_solver(spark):
    rng = random.Random(2)
    sources = {"some": (0.8, [rng.randrange(1, 300) for _ in range(80)]), "more": (1.6, [rng.choice([1, 2, 5, 40, 900]) for _ in range(200)]),
               "most": (2.0, [3, 7, 7, 100]), "few": (0.01, [rng.randrange(1, 2000) for _ in range(50)]), "same": (1.5, [10] * 9)}
    cells, targets, expected = {}, [], {}
    for key, (part, sizes) in sources.items():
        for size in sizes:
            cells[key, size] = cells.get((key, size), 0) + 1
        targets.append((key, sum(sizes), part * sum(sizes)))
        expected.update(zip([(key, size) for size in sizes], solved(sizes, part * sum(sizes))))
    frame = spark.createDataFrame([(*k, n) for k, n in cells.items()], "_key string, _size long, _n long")
    got = mixing.entropy_rates(frame, spark.createDataFrame(targets, "_key string, source_size long, target double")).collect()
    for r in got:
        assert r._rate == pytest.approx(expected[r._key, r._size], rel=1e-4, abs=1e-9), (r._key, r._size)
    # shorter documents of a source with a small target come more often, of one with a large target longer ones
    for key, sign in (("some", -1), ("few", -1), ("more", 1)):
        rates = [r._rate for r in sorted(got, key=lambda r: r._size) if r._key == key]
        assert all(sign * (b - a) >= 0 for a, b in zip(rates, rates[1:])) and len(set(rates)) > 2


def test_many_sizes_in_one_source(spark):
    cells = spark.range(1, 200_001).select(F.lit("s").alias("_key"), F.col("id").alias("_size"), F.lit(1).cast("long").alias("_n"))
    words = 200_000 * 200_001 // 2
    rated = cells.select("*", F.lit(words).alias("source_size"), F.lit(0.7 * words).alias("target"), F.lit(0.7).alias("_rate"))
    got = mixing.whole_copies(rated).agg(F.sum(F.col("_copies") * F.col("_size")).alias("words"), F.count(F.lit(1)).alias("n")).first()
    assert got.n == 200_000 and abs(got.words - 0.7 * words) <= 1


def test_query(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, r.source) for r in table]
    by_id = {r.doc_id: r for r in table}
    got = queries.op5_mix_sources(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(by_id)
    targets = brute_targets({s: sum(words(t) for _, t, x in rows if x == s) for s in {r[2] for r in rows}})
    for source, target in targets.items():
        own = [r for r in got if by_id[r.doc_id].source == source]
        assert {round(r.target, 6) for r in own} == {round(target, 6)}
        assert abs(sum(r.taken for r in own) - target) <= 0.02 * target
        assert all(0 <= r.taken <= 2 * r.size for r in own)
