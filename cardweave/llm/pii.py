"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

The base kinds (email, ip, card, phone) are reported whenever their pattern and check hold, as their contract says;
their score tells how sure they are. The method adds kinds whose pattern alone says little (iban, ssn, local phone):
these need a valid checksum or number range and a score of at least KEEP. Context words within WINDOW code points
raise or lower every score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, overlap, spans_sha256, spans_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
WINDOW, KEEP = 48, 0.5

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Each pattern starts where a run starts: what fails there fails in the rest of the run, and texts take linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])++")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")

#: The length of an IBAN by country.
IBAN_LENGTHS = {
    c: n for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for c in countries.split()
}

#: Score of a confirmed span without context, and the words that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.6, "ssn": 0.3, "local_phone": 0.3}
RAISE = {
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "mastercard", "amex", "payment", "cvv"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "bank", "account", "swift", "bic"),
    "ssn": ("ssn", "social security", "tax id", "taxpayer"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
}
LOWER = {"iban": ("part no", "serial", "order no"), "ip": ("version", "release"), "card": ("order", "tracking", "serial", "isbn"), "ssn": ("part no", "serial", "isbn"), "local_phone": ("part no", "serial", "isbn")}


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        for d in str(int(c, 36)):
            rest = (rest * 10 + int(d)) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a domain after it, and the local part before it that an earlier match hasn't taken."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose pattern and check hold."""
    for start, stop in emails(text) if "@" in text else ():
        yield "email", start, stop
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()
    for m in IBAN.finditer(text):
        # The country settles the length; the pattern may run on into capital words after it.
        left, stop = IBAN_LENGTHS.get(m[0][:2], 0), m.start()
        while left and stop < m.end():
            left -= text[stop] != " "
            stop += 1
        if left == 0 and stop > m.start() and not text[stop : stop + 1].isalnum() and mod97(text[m.start() : stop].replace(" ", "")):
            yield "iban", m.start(), stop
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span()


def context_score(text: str, kind: str, start: int, stop: int) -> float:
    near = (text[max(0, start - WINDOW) : start] + " " + text[stop : stop + WINDOW // 2]).lower()
    score = PRIOR[kind] + 0.25 * any(re.search(rf"\b{re.escape(w)}", near) for w in RAISE[kind])
    return max(0.0, min(1.0, score - 0.35 * any(w in near for w in LOWER.get(kind, ()))))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, stop, score) by start, then by the order of KINDS."""
    spans = list(proposed(text))
    based = overlap((start, stop) for kind, start, stop in spans if kind in BASE)
    found = []
    for kind, start, stop in spans:
        score = context_score(text, kind, start, stop)
        if kind in BASE or (score >= KEEP and not based(start, stop)):
            found.append((kind, start, stop, score))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of (kind, start, stop, score) in code points, stop exclusive.

    Whole texts; a null or empty text has no spans. Repeated rows get equal rows, an empty table none; other columns
    are ignored.
    """

    def work(columns: list[list]) -> list[list]:
        return [columns[0], [[dict(zip(("kind", "start", "stop", "score"), s, strict=True)) for s in find(t or "")] for t in columns[1]]]

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, work, "doc_id bigint, spans array<struct<kind: string, start: bigint, stop: bigint, score: double>>")


def mask(text: str) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, stop, _ in find(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = stop
    return "".join([*out, text[at:]])


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of spans()' rows, and scores: the spans' scores in their order, comma-joined."""
    s = F.col("spans")
    scores = F.array_join(F.transform(s, lambda x: F.format_number(x["score"], 2)), ",")
    return found.select("doc_id", *(number(s, k).alias(f"n_{k}") for k in BASE), spans_sha256(s, BASE).alias("base_sha256"), spans_text(s).alias("spans"), scores.alias("scores"))
