"""Personal data: proposed by patterns, confirmed by checksums, weighed by context."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order of the output. The first four are the base.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
# Score of a proposed span by kind, what a context word near it adds, and from which
# score on a span that is not of the base is kept.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.2, "short card": 0.2}
CONTEXT_BONUS = 0.4
ACCEPTED = 0.5
CONTEXT_CHARS = 48
# Words that speak for a kind when they stand near.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security", "tax id"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats give what the plain ones would, since what follows them cannot
# match within them; a run of digits is looked at once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
# Characters of an IBAN by country.
_IBAN_LENGTH = {
    code: length
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", at + 1)


def _ibans(text: str):
    """The end is where the country's length says, for other countries the last end of a
    token that mod 97 confirms: capitals and digits may follow after a space."""
    end = 0
    for start in _IBAN_START.finditer(text):
        m = _IBAN.match(text, start.start()) if start.start() >= end else None
        wanted = _IBAN_LENGTH.get(start[0][:2])
        for at in range(m.end(), m.start() + 14, -1) if m else ():
            shown = text[m.start() : at].replace(" ", "")
            if text[at - 1] == " " or at < len(text) and text[at].isascii() and text[at].isalnum():
                continue
            if len(shown) == wanted or wanted is None and len(shown) >= 15:
                if mod97(shown):
                    end = at
                    yield m.start(), at
                    break


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposed(text: str):
    """(kind, start, end) of all spans that pass their checks; "short card" for cards of
    13 to 15 digits."""
    yield from (("email", a, b) for a, b in _emails(text))
    if "." in text:
        yield from (("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split("."))))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card" if len(digits) >= 16 else "short card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()
    yield from (("iban", a, b) for a, b in _ibans(text))
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()


def scored(text: str):
    """(kind, start, end, score, base) of the spans kept, by kind, then start."""
    spans = []
    for kind, start, end in proposed(text):
        shown = "card" if kind == "short card" else kind
        around = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}".lower()
        near = any(re.search(rf"(?<!\w){re.escape(word)}(?!\w)", around) for word in CONTEXT[shown])
        score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * near)
        base = kind in BASE_KINDS
        if base or score >= ACCEPTED:
            spans.append((shown, start, end, score, base))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_private(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and found, an array of (kind, start, end, score,
    base), places in code points, the end exclusive.

    Regular expressions propose spans, leftmost first and without overlap within a
    kind; checksums and ranges confirm them (Luhn for cards, mod 97 for IBANs, parts of
    addresses, digits of numbers), a failing match is dropped and not tried again; an
    IBAN is as long as its country has it, whatever follows.
    Context words within 48 characters raise the score. Base kinds are kept at any
    score; cards of 13 to 15 digits and social security numbers only with context.

    A null or empty text has no spans. Repeated rows are rows of their own. An empty table
    gives no rows. Other columns are not looked at.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, found array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"

    def find(batches):
        import pyarrow as pa

        fields = ("kind", "start", "end", "score", "base")
        item = pa.struct(zip(fields, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())))
        for batch in batches:
            found = [[dict(zip(fields, s)) for s in scored(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(item))], ["doc_id", "found"])

    return docs.select(doc_id, text).mapInArrow(find, schema)


def span_digest(found: Column, base_only: bool) -> Column:
    """The spans as kind:start:end, comma-joined."""
    spans = F.filter(found, lambda s: s["base"]) if base_only else found
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
