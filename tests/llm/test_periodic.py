import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from guestlens.llm import periodic, queries


def brute(words):
    """All runs by their definition, from every start and period."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i  # words i .. end + q - 1 have the period q
            if length >= max(6, 4 * q) and not any(q % d == 0 and all(words[i + k] == words[i + k + d] for k in range(length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = max(end, i + 1) if end > i else i + 1
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def some_words(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(60))]
    if kind == 1:
        return [rng.choice("abc") for _ in range(rng.randrange(40))]
    words = []
    for _ in range(rng.randrange(1, 6)):
        base = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 9))]
        words += base * rng.randrange(1, 9) + base[: rng.randrange(len(base) + 1)]
        words += [rng.choice("abcdefgh") for _ in range(rng.randrange(4))]
    return words


def test_runs_against_brute_force():
    rng = random.Random(12)
    some, overlapping = 0, 0
    for _ in range(1500):
        words = some_words(rng)
        expected = brute(words)
        assert periodic.runs_of(words) == expected, words
        assert periodic.collapse(words, expected) == brute_collapse(words, expected)
        some += bool(expected)
        overlapping += any(a[0] + a[1] > b[0] for a, b in zip(expected, expected[1:]))
    assert some > 500 and overlapping > 50


def test_stretches_lose_no_run():
    rng = random.Random(13)
    for _ in range(300):
        words = [f"w{rng.randrange(30)}" for _ in range(400)]
        for _ in range(3):
            at, q = rng.randrange(300), rng.randrange(1, 20)
            words[at : at + 5 * q] = words[at : at + q] * 5
        ids = np.unique(words, return_inverse=True)[1]
        starts, ends = periodic.repetitive_stretches(ids)
        runs = brute(words)
        assert runs and all(any(s <= a and a + n <= e for s, e in zip(starts, ends)) for a, n, _ in runs)
        assert (ends - starts).sum() < 400  # and most of the text is passed over
        assert periodic.runs_of(words) == runs


def test_suffix_tree_and_extensions():
    rng = random.Random(14)
    for letters in (1, 2, 4):
        text = [rng.randrange(1, letters + 1) for _ in range(200)]
        tree = periodic.SuffixTree(text, letters + 1)
        suffixes = [text[i:] for i in range(201)]
        assert sorted(range(201), key=lambda i: tree.first[i]) == sorted(range(201), key=suffixes.__getitem__)
        opposite = tree.opposite_ranks()
        assert sorted(range(201), key=lambda i: opposite[i]) == sorted(range(201), key=lambda i: [-s for s in suffixes[i]])
        a = np.array([rng.randrange(200) for _ in range(3000)])
        b = (a + [rng.randrange(1, 201) for _ in range(3000)]) % 201
        same = lambda x, y: next((k for k, (p, q) in enumerate(zip(suffixes[x], suffixes[y])) if p != q), min(200 - x, 200 - y))
        assert tree.common(a, b).tolist() == [same(x, y) for x, y in zip(a.tolist(), b.tolist())]


def rows_of(docs):
    out = []
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = periodic.runs_of(words) if n > 2000 else brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        collapsed = b" ".join(brute_collapse(words, runs))
        out.append((doc_id, len(runs), *first, sha256(lines.encode()).hexdigest(), sha256(collapsed).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op12_find_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = rows_of(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    assert sum(r[1] > 0 for r in expected) > 5


@pytest.fixture
def written(spark, docs):
    from guestlens.session import new_path

    def write(rows):
        folder = new_path(spark, "tables")
        docs(rows, "runs", "collapsed", "start", "_best").write.parquet(f"{folder}/documents.parquet")
        return folder

    return write


def test_odd_texts(spark, written):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a a a a a a"), (4, "a b " * 50_000), (5, "x " * 6), (5, "x " * 6), (5, "x " * 5),
            (6, "Ä ä " * 9 + "  \x1c b\x0bc"), *((i, "p q r s t u v w x y z " * 3) for i in range(100, 160))]
    got = queries.op12_find_periodic_runs(spark, written(rows)).collect()
    expected = rows_of([r for r in rows if r[0] != 4])
    assert sorted((tuple(r) for r in got if r.doc_id != 4), key=str) == expected
    (long,) = [r for r in got if r.doc_id == 4]
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 100_000, 2)
    assert queries.op12_find_periodic_runs(spark, written([])).count() == 0


def test_operator_returns_texts(docs):
    (row,) = periodic.find_runs(docs([(1, "so  be it " + "no no no no no no no " + "end")])).collect()
    assert [tuple(r) for r in row.runs] == [(3, 7, 1)] and row.collapsed == "so be it no end"
