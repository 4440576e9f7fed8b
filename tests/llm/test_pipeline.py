import random
from hashlib import sha256

import sentencepiece

import __spark_entry__
import corpus_pipeline
from guestlens.llm import mixing, queries, sql
from guestlens.session import new_path, stage
from test_simhash import brute


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(sql.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) >= 10
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mix sources", "encode pieces"]


def test_against_brute_force(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    clean = [text() for _ in range(40)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(clean)]
    rows += [(100 + i, t.replace(" ", "  "), f"s{i % 3}") for i, t in enumerate(clean[:10])]  # exact but for white space
    rows += [(200 + i, t + " end", f"s{i % 3}") for i, t in enumerate(clean[10:20])]  # near
    rows += [(300 + i, text() + " idiot scum " + text(), "s0") for i in range(30)]  # toxic
    labels = [(300 + i, 1, 1) for i in range(30)] + [(i, 1, 0) for i in range(40)]
    folder = new_path(spark, "tables")
    columns = "doc_id long, text string, source string"
    spark.createDataFrame(rows, columns).selectExpr("*", "'en' AS lang", "length(text) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    left = [(i, t) for i, t, _ in rows if i < 100 or 200 <= i < 300]  # neither toxic nor an exact copy
    left = sorted({component for _, _, component in brute(left)})
    assert set(range(40)) <= set(left) and len(left) < 50  # some near copies are within the distance

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    remaining = []
    for _, apply in corpus_pipeline.STAGES[:3]:
        docs = apply(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "source", "lang", "n_chars"]
        remaining.append(docs.count())
    assert remaining == [60, 50, len(left)]
    assert sorted(r.doc_id for r in docs.collect()) == left

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    got = corpus_pipeline.run(spark, folder).collect()
    digests = {i: sha256(" ".join(map(str, library.encode(t, add_eos=True))).encode()).hexdigest() for i, t, _ in rows}
    assert all(r.agrees and r.ids_sha256 == digests[r.doc_id] for r in got)
    times = {i: sum(r.doc_id == i for r in got) for i in left}
    assert set(times.values()) <= {0, 1, 2} and sum(times.values()) == len(got) and abs(len(got) - 1.5 * len(left)) <= 1


def test_given_tables_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: (r.text or "", r.source) for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    toxic = {r.doc_id for r in queries.op8_find_toxic(spark, sf).where("toxic").collect()}
    docs = stage(stages["toxicity"](spark, docs, sf), "one")
    left = sorted(r.doc_id for r in docs.collect())
    assert left == sorted(rows.keys() - toxic)

    smallest = {}
    for i in left:
        smallest.setdefault(b" ".join(rows[i][0].encode().split()), i)
    docs = stage(stages["exact dedup"](spark, docs, sf), "two")
    left = sorted(smallest.values())
    assert sorted(r.doc_id for r in docs.collect()) == left

    found = brute([(i, rows[i][0]) for i in left])
    docs = stage(stages["near dedup"](spark, docs, sf), "three")
    left = sorted({c for _, _, c in found})
    assert sorted(r.doc_id for r in docs.collect()) == left

    mixed, names = mixing.mix_sources(docs)
    copies = {r.doc_id: r[names["copies"]] for r in mixed.collect()}
    docs = stage(stages["mix sources"](spark, docs, sf), "four")
    assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i in left for _ in range(copies[i]))

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    got = stages["encode pieces"](spark, docs, sf).collect()
    assert len(got) == sum(copies.values())
    for r in got:
        assert r.agrees and r.ids_sha256 == sha256(" ".join(map(str, library.encode(rows[r.doc_id][0], add_eos=True))).encode()).hexdigest()


def test_nothing_and_no_labels(spark, sf):
    folder = new_path(spark, "tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.where("false").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").where("false").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert corpus_pipeline.toxicity_stage(spark, docs, folder).count() == docs.count()
