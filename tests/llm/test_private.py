import random
import re
from hashlib import sha256

from guestlens.llm import private, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(number):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10 == 0

    spans = [("email", m) for m in EMAIL.finditer(text)]
    spans += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", m) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    spans += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return [f"{kind}:{m.start()}:{m.end()}" for kind, m in spans]


def base_of(text):
    return [f"{k}:{a}:{b}" for k, a, b, _, base in private.scored(text or "") if base]


def test_base_against_plain_patterns():
    rng = random.Random(8)
    parts = ["a@b.co", "@", ".", "+", "1", "42", "255", "256", "0", "-", " ", "x", "4111 1111 1111 1111", "+49 (30) 1234567", "1.2.3.4",
             "é", "4111-1111-1111-1111-0", "\n", "_%", "..", "0001"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert base_of(text) == brute(text), repr(text)


def test_long_runs_take_linear_time():
    for piece in ("1", "a", "a.", "1.", "@", "+1", "1-", "A0", "a@", "+ "):
        private.scored(piece * 200_000)


def test_method_adds_confirmed_spans():
    iban, bad = "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01"
    kinds = lambda text: [s[0] for s in private.scored(text)]
    assert "iban" in kinds(f"x {iban} y") and "iban" not in kinds(f"x {bad} y")
    assert kinds("ssn: 078-05-1120") == ["ssn"] and kinds("078-05-1120") == []
    assert kinds("amex 378282246310005") == ["card"] and kinds("378282246310005") == []
    near, far = private.scored("mail me a@b.co")[0], private.scored("a@b.co")[0]
    assert near[3] > far[3]


def test_iban_before_capitals_and_digits():
    german, french = "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606"
    for iban in (german, german.replace(" ", ""), french):
        for text in ("IBAN {} BIC COBADEFF", "{} 2024", "AB12 CDEF {} {} END", "{}, X", "{} and"):
            found = [text.format(iban, iban)[a:b] for kind, a, b in private.proposed(text.format(iban, iban)) if kind == "iban"]
            assert found == [iban] * text.count("{}")
    assert not any(kind == "iban" for kind, *_ in private.proposed(f"{german}X {german}0 x{german}"))


def test_frame(docs):
    rows = [(1, None), (2, ""), (None, "😀 a@b.co"), (3, "x " * 60_000 + "1.2.3.4"), (3, "a@b.co"), (3, "a@b.co")]
    got = private.find_private(docs(rows, "found", "spans")).collect()
    shown = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.found]) for r in got)
    assert shown == sorted([("1", []), ("2", []), ("None", [("email", 2, 8)]), ("3", [("ip", 120_000, 120_007)]),
                            ("3", [("email", 0, 6)]), ("3", [("email", 0, 6)])])
    assert private.find_private(docs([]).where("false")).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op9_find_private(spark, sf).collect():
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in private.BASE_KINDS]
        assert set(spans) <= set(r.spans.split(","))
