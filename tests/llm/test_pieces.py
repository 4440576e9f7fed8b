import random
from hashlib import sha256

import pytest
import sentencepiece

from guestlens.llm import pieces, queries

ODD = ["", " ", "  a  b", "a\n\nb", " \n ", "▁▁x y▁", "日本語😀é́", "x" * 3000, "\x00\t", "don't  stop\r\n", "aaaa" * 50, "<s></s><unk><0x0A>",
       "a.b,c!?;: (d) [e]_f__g-h", "Ünïcödé m² m². ½", "1234567890.99", "ſt İ K"]


@pytest.fixture(scope="module")
def encoder():
    with open(queries.piece_model(), "rb") as file:
        return pieces.MergeEncoder(file.read(), remembered=50)


def test_agenda_gives_the_ids_of_the_library(encoder):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz  \n.,'▁éß日0123"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)]
    right = encoder.library.encode(texts, add_eos=True)
    assert encoder.encode(texts) == [(ids, True) for ids in right]
    assert [encoder.encode([t])[0] for t in texts] == [(ids, True) for ids in right]
    assert [encoder.decode(ids).decode() for ids in right] == [encoder.library.decode(ids) for ids in right]
    assert len(encoder.known) <= 50 and len(encoder.known_parts) <= 50
    assert encoder.encode([]) == [] and not encoder.differing
    texts = [" ".join(rng.choice(["|", "a|b", "|a", "a", "ab,", "a.b.c", "é", "12", "x\ny"]) for _ in range(rng.randrange(6))) for _ in range(400)]
    assert [e for t in texts for e in encoder.encode([t])] == [(ids, True) for ids in encoder.library.encode(texts, add_eos=True)]


def test_the_two_agendas_agree(encoder):
    rng = random.Random(8)
    parts = ["▁international", "▁▁▁", "hello", "aaaaaaaa", "日", "x😀y"]
    parts += ["".join(rng.choice("▁theringsau日é0") for _ in range(rng.randrange(1, 24))) for _ in range(500)]
    assert encoder.merge_short(parts) == [encoder.merge_long(p) for p in parts]


def test_a_wrong_agenda_shows(monkeypatch):
    with open(queries.piece_model(), "rb") as file:
        encoder = pieces.MergeEncoder(file.read())
    merge = encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda parts: {p: (5,) if "odd" in p else ids for p, ids in merge(parts).items()})
    texts = ["some odd text", "some text", "an odd, text", "another odd", "  odd", "  even", "odd"]
    for _ in range(2):  # from the store too
        assert [agrees for _, agrees in encoder.encode(texts)] == [False, True, False, False, False, True, False]
    assert encoder.encode(["odd"])[0][0] == [5, encoder.end]


def test_frame(docs):
    rows = [*enumerate(ODD), (None, None), (0, ""), (99, "word " * 30_000)]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    got = pieces.encode_pieces(docs(rows, "ids", "decoded", "agrees"), queries.piece_model()).collect()
    expected = [(str(d), ids := library.encode(t or "", add_eos=True), len(ids), library.decode(ids), True) for d, t in rows]
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(expected)
    assert pieces.digest_pieces(docs([]).where("false"), queries.piece_model()).count() == 0


def test_query(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op7_encode_pieces(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.agrees and r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(ids).encode()).hexdigest()
