import math
import random
import re

import compare

from guestlens.llm import licences, queries, sql

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels, score = [], set(), 0.0
    for phrase, label in licences.PHRASES.items():
        parts = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += here
        labels |= {label} if here else set()
    base = ",".join(sorted(labels))
    for start in [0, *range(32, max(0, len(words) - 32), 32)]:
        block = set(words[start : start + 64])
        for label, template in licences.TEMPLATES:
            wanted = set(template.split())
            if len(block & wanted) >= math.ceil(0.8 * len(wanted) - 1e-9):
                labels.add(label)
                score = max(score, len(block & wanted) / len(wanted))
    score = 1.0 if base else score
    first, last = min(places, default=None), max(places, default=None)
    return len(words), len(places), first, last, base, ",".join(sorted(labels)), round(score, 9)


def test_against_brute_force(docs):
    rng = random.Random(4)
    filler = "the of and under by a to in version work 2 0 any other word éclair naïve".split()
    texts = [None, "", " \n\t", "CC BY", "cc-by cc by-sa CC\u00a0BY", "all rights  reserved. All Rights Reserved!", "cc cc by by"]
    for _, template in licences.TEMPLATES:
        words = template.split()
        for drop in range(4):
            kept = [w for i, w in enumerate(words) if i % 6 >= drop or drop == 0]
            rng.shuffle(kept)
            around = [rng.choice(filler) for _ in range(rng.randrange(150))]
            at = rng.randrange(len(around) + 1)
            texts.append(" ".join(around[:at] + kept + around[at:]).title())
    texts.append("general public " * 9000 + "license")
    rows = list(enumerate(texts)) + [(3, "CC BY"), (None, "all rights reserved")]
    got = licences.scan_licences(docs(rows, "labels", "words", "word", "_row")).collect()
    key = lambda row: tuple(map(str, row))
    mine = sorted(((r.doc_id, *tuple(r)[1:7], round(r.score, 9)) for r in got), key=key)
    assert mine == sorted(((d, *brute(t)) for d, t in rows), key=key)
    assert len({r.labels for r in got}) > 5


def test_long_templates(docs):
    rng = random.Random(5)
    long, longer = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (90, 300))
    around = lambda n: " ".join(f"v{rng.randrange(50)}" for _ in range(n))
    less = " ".join(longer.split()[:230])  # 0.77 of the template
    rows = [(i, f"{around(i * 37)} {text} {around(i * 11)}") for i, text in enumerate([long, longer, less, long.upper()] * 5)]
    rows.append((100, longer))
    got = licences.scan_licences(docs(rows), templates=(("a", long), ("b", longer)))
    assert {r.doc_id: r.labels for r in got.collect()} == {**{i: ("a", "b", "", "a")[i % 4] for i in range(20)}, 100: "b"}


def test_query_against_sql(spark, sf):
    found = queries.op4_scan_licences(spark, sf)
    assert compare.differences(found, sql.ORACLES["op4_scan_licences"], compare.connect(sf)) == []


def test_empty_table(docs):
    assert licences.scan_licences(docs([]).where("false")).count() == 0
