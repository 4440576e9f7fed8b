import numpy as np

from guestlens.llm import neighbours, queries

FORM = "vec_id long, embedding array<float>, rank string, score string, v string"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, "r", "s", "v") for i, v in rows], FORM).repartition(4)


def brute(ids, vectors, wanted=20, every=20):
    found = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = (vectors * vectors[i]).sum(axis=1)
        others = ids != ids[i]
        order = np.lexsort((ids[others], -scores[others]))[:wanted]
        found[int(ids[i])] = list(zip(ids[others][order].tolist(), scores[others][order].tolist()))
    return found


def answers(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, expected):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in e}) for q, e in expected.items())
    return hits / sum(len(e) for e in expected.values())


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    ids, vectors = np.arange(6000), rng.standard_normal((6000, 32)).astype(np.float32)
    vectors *= rng.uniform(0.5, 2, size=(6000, 1)).astype(np.float32)  # lengths differ
    got = answers(neighbours.nearest_neighbours(frame_of(spark, zip(ids.tolist(), vectors.tolist())), shard_vectors=2500))
    expected = brute(ids, vectors.astype(float))
    assert got.keys() == expected.keys() and all(len(a) == 20 for a in got.values())
    assert recall(got, expected) >= 0.9
    for q, found in got.items():
        for i, score in found:
            assert abs(score - vectors[q].astype(float) @ vectors[i].astype(float)) < 1e-9


def test_ties_copies_and_rows_that_take_no_part(spark):
    one, two = [1.0, 0.0], [0.6, 0.8]
    rows = [(i, one) for i in range(30)] + [(100, two), (101, None), (102, [0.0, 0.0]), (103, [1.0, None]),
                                           (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (None, one), (20, one)]
    got = answers(neighbours.nearest_neighbours(frame_of(spark, rows), wanted=3))
    assert [i for i, _ in got[0]] == [1, 2, 3] and [i for i, _ in got[20]] == [0, 1, 2] and [i for i, _ in got[100]] == [0, 1, 2]
    assert got.keys() == {0, 20, 100}


def test_repeats_of_one_id(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((66_000, 2))
    index = neighbours.CollisionIndex(np.full(66_000, 7), vectors, 8, 8, 0.01)
    assert (np.sort(index.place, axis=1) == np.arange(66_000)).all()
    rows = [(7, [1.0, float(i)]) for i in range(400)] + [(20, [1.0, 0.0])]
    good = neighbours.dealt(frame_of(spark, rows).selectExpr("vec_id", "cast(embedding as array<double>) v"), 4)
    counts = [r["count"] for r in good.where("vec_id = 7").groupBy("shard").count().collect()]
    assert len(counts) == 4 and max(counts) < 200


def test_one_malformed_vector_of_the_smallest_id(spark):
    rows = [(0, [1.0]), *((i, [1.0, float(i)]) for i in range(20, 60))]
    got = answers(neighbours.nearest_neighbours(frame_of(spark, rows), wanted=2))
    assert got.keys() == {20, 40} and [i for i, _ in got[20]] == [59, 58]


def test_few_and_none(spark):
    got = answers(neighbours.nearest_neighbours(frame_of(spark, [(0, [1.0, 2.0]), (3, [2.0, 1.0])])))
    assert [i for i, _ in got[0]] == [3]
    assert neighbours.nearest_neighbours(frame_of(spark, [(0, [1.0])])).count() == 0
    assert neighbours.nearest_neighbours(frame_of(spark, [(0, None)])).count() == 0


def test_query_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    vectors = np.stack(table["embedding"].to_list()).astype(float)
    expected = brute(table["vec_id"].to_numpy(), vectors)
    got = answers(queries.op3_nearest_neighbours(spark, sf))
    assert got.keys() == expected.keys() and recall(got, expected) >= 0.9
