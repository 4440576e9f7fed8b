import hashlib
import re

import compare
import pytest

from guestlens.llm import exact, queries, sql


def brute(rows):
    """doc_id -> (keep_id, group_size, digest) for unique ids."""
    digest = {d: hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest() for d, t in rows}
    groups = {}
    for d, h in digest.items():
        groups.setdefault(h, []).append(d)
    return {(d, min(groups[h]), len(groups[h]), min(groups[h]) == d, h) for d, h in digest.items()}


@pytest.mark.parametrize("support", [0.5, 0.05, 0.001])
def test_against_brute_force(docs, support):
    rows = [(i, "same\t text" if i % 3 == 0 else f"text {i % 7} " if i % 3 == 1 else f"only {i}") for i in range(90)]
    rows += [(100, None), (101, ""), (102, " "), (103, "\n\t"), (104, "same text"), (105, "x " * 50_000)]
    got = exact.exact_dedup(docs(rows, "keep_id", "_row"), support=support)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_repeated_rows_and_null_ids(docs):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "n"), (None, "n")]
    got = exact.exact_dedup(docs(rows)).collect()
    assert len(got) == 6 and {r.group_size for r in got if r.keep_id == 1 and r.kept} == {3, 1}
    assert sum(r.kept for r in got) == 3
    assert sorted((r.doc_id, r.text, r.mine) for r in exact.drop_exact_copies(docs(rows, "mine")).collect() if r.doc_id) == [
        (1, "a", "mine"), (1, "b", "mine")
    ]
    assert exact.drop_exact_copies(docs(rows)).count() == 3


def test_empty_table(docs):
    assert exact.exact_dedup(docs([]).where("false")).count() == 0
    assert exact.drop_exact_copies(docs([]).where("false")).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_query_against_sql(spark, sf):
    assert compare.differences(queries.op2_exact_dedup(spark, sf), sql.ORACLES["op2_exact_dedup"], compare.connect(sf)) == []
