import random

import numpy as np

from guestlens.llm import queries, toxicity

FORM = "doc_id long, quality int, toxic int"


def corpus(n, seed, first=0):
    """Texts of which a tenth hold abuse, some of it in an invented language by a stem."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 400]))]
        bad = i % 10 == 0
        if bad:
            for _ in range(2):
                mark = rng.choice(["idiot", "scum", "trash"]) if i % 20 else f"grumo{rng.choice('abcdefgh')}{rng.choice('xyz')}"
                words.insert(rng.randrange(len(words)), mark)
        rows.append((first + i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark, docs):
    train, test = corpus(1200, 1), corpus(600, 2, first=10_000)
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in train], FORM)
    got = toxicity.find_toxic(docs([r[:2] for r in train + test], "toxic", "score"), labels).collect()
    found = {r.doc_id: r.toxic for r in got}
    bad = [found[d] for d, _, y in test if y]
    good = [found[d] for d, _, y in test if not y]
    assert sum(bad) / len(bad) >= 0.95 and sum(good) / len(good) <= 0.005
    assert all(0 <= p <= 1 for r in got for p in (r.p_insult, r.p_contempt, r.score))
    kept = toxicity.drop_toxic(docs([r[:2] for r in test], "score"), labels.where("false"))
    assert kept.count() == len(test)  # nothing is known, so nothing goes


def test_later_models_use_the_earlier_categories():
    rng = np.random.default_rng(0)
    first = rng.integers(0, 2, 400)
    present = [[0] if y else [] for y in first]
    chain = toxicity.fit_chain(["a"], present, {"one": first.tolist(), "two": first.tolist()})
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert chain.weights[1][-1] > 0
    high, low = chain.probabilities([0]), chain.probabilities([])
    assert high[0] > 0.9 and high[1] > 0.9 and low[0] < 0.1 and low[1] < 0.1


def test_labels_of_unknown_documents_take_no_place(spark, docs):
    known = corpus(200, 7)
    unknown = [(50_000 + i, 1, i % 2) for i in range(4000)]
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in known] + unknown, FORM)
    frame = docs([r[:2] for r in known])
    with_others, alone = (toxicity.train(frame, some, rows=150) for some in (labels, labels.where("doc_id < 50000")))
    assert with_others.features == alone.features and with_others.weights == alone.weights
    assert len(alone.features) > 1


def test_query_on_the_given_tables(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_find_toxic(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    chain = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        p = chain.probabilities(chain.present(toxicity.words_of(r.text)))
        assert got[r.doc_id].score == p[-1] and got[r.doc_id].toxic == (p[-1] >= toxicity.REJECTED)
    assert sum(got[d].toxic for d, y in toxic.items() if not y) == 0


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (None, "idiot scum"), (3, "idiot " * 50_000), (3, "fine"), (4, "trash"), (4, "trash")]
    labels = spark.createDataFrame([(3, 1, 1), (3, None, None), (None, 1, 1), (99, 0, 1), (2, 0, 0), (1, 1, 0), (4, 1, 1), (4, 1, 0)], FORM)
    assert toxicity.find_toxic(docs(rows, "_p", "_text"), labels).count() == len(rows)
    assert toxicity.find_toxic(docs([]).where("false"), labels).count() == 0
    nothing = toxicity.find_toxic(docs(rows), labels.where("false")).collect()
    assert len(nothing) == len(rows) and not any(r.toxic for r in nothing)


def test_logistic_fit():
    rng = np.random.default_rng(3)
    x = np.c_[np.ones(2000), rng.standard_normal((2000, 2))]
    y = (rng.random(2000) < 1 / (1 + np.exp(-(x @ [0.5, 2.0, -1.0])))).astype(float)
    assert np.allclose(toxicity.fit_logistic(x, y), [0.5, 2.0, -1.0], atol=0.3)
    assert toxicity.fit_logistic(x, np.zeros(2000))[0] < -5 and toxicity.fit_logistic(x[:0], y[:0])[0] == -30
