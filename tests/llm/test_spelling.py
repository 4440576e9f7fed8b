import random
import re
import zlib
from collections import Counter

import pytest

from guestlens.llm import queries, spelling


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    made = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
    return (made | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {word}


def brute(counts):
    letters = sorted({c for w in counts for c in w})
    rows, forms = {}, {}
    for w, n in counts.items():
        near = [x for x in edits(w, letters) if x in counts]
        best = min(near, key=lambda x: (-counts[x], x.encode()), default=None)
        if best is not None and counts[best] >= 2 * n:
            forms[w] = best
        rows[w] = len(near)
    out = []
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, rows[w], counts[forms[w]] if w in forms else None))
    return sorted(out)


def runs_of(doc_id, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        yield run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def counted(rows):
    counts = Counter(w for d, t in rows for w in runs_of(d, t))
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def frame(spark, counts):
    return spark.createDataFrame([(w, n, "mine") for w, n in counts.items()], "word string, n long, near string").repartition(3)


def variants(spark, counts):
    return sorted(map(tuple, spelling.spelling_variants(frame(spark, counts)).collect()))


@pytest.mark.parametrize("letters", ["ab", "abcdé", "aeiourstlnÿ÷"])
def test_random_words_against_brute_force(spark, letters):
    rng = random.Random(len(letters))
    counts = {}
    for _ in range(150):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 9)))
        for w in [word, *rng.sample(sorted(edits(word, letters)), 3)]:
            if len(w) >= 5:
                counts[w] = rng.choice([3, 5, 5, 10, 20, 40, 300])
    expected = brute(counts)
    assert variants(spark, counts) == expected
    assert sum(r[1] is not None for r in expected) > 50 and any(r[1] != r[2] for r in expected if r[1])


def test_repeated_letters_and_ties(spark):
    counts = {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "baaaaa": 6, "abababab": 3, "babababa": 9, "bababab": 6, "zebra": 4}
    got = variants(spark, counts)
    assert got == brute(counts)
    assert ("aaaaa", "aaaaaa", "aaaaaaaa", 3, 2, 6) in got  # of equal near words the smallest, followed to the last


def test_long_words_and_hot_grams(spark):
    rng = random.Random(4)
    counts = {"x" * 4000: 5, "x" * 3999 + "y": 3, "x" * 4001: 50}
    for _ in range(400):  # all share their grams and lengths
        counts["ababab" + "".join(rng.choice("ab") for _ in range(6))] = rng.randrange(3, 50)
    assert variants(spark, counts) == brute(counts)


def test_bounds(spark):
    assert spelling.spelling_variants(frame(spark, {"words": 3}).where("false")).count() == 0
    assert variants(spark, {"alone": 3, None: 5}) == [("alone", None, "alone", 3, 0, None)]
    with pytest.raises(ValueError):
        variants(spark, {"abc": 3})
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame(spark, {"words": 3}), ratio=1)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op11_group_spellings(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute(counted(docs))
    assert sorted(map(tuple, got.collect())) == expected
    assert any(r[1] for r in expected)


def test_words_of_odd_texts(spark, docs):
    rows = [(1, None), (2, ""), (3, "Été ÉTÉ été it's x×y÷z Straße"), (4, "LONG" * 30_000), (None, "Abc"), (5, "same same same"), (5, "same same same")]
    got = Counter((r.doc_id, r.word) for r in queries.altered_runs(docs(rows, "run", "word")).collect())
    expected = Counter((d, w) for d, t in rows if d is not None for w in runs_of(d, t))
    assert Counter({k: n for k, n in got.items() if k[0] is not None}) == expected
    assert got[(None, "abc")] == 1  # without an id nothing is deleted
    assert {r.word: r.n for r in spelling.frequent_words(queries.altered_runs(docs(rows))).collect()} == counted([r for r in rows if r[0] is not None])
