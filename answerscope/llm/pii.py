"""Personal data: patterns propose spans, checksums confirm them, context adjusts their score.

Kinds with fixed patterns: email, ip (parts at most 255), card (13 to 19
digits passing Luhn), phone (9 to 15 digits). More kinds: iban (mod-97), ssn
(three groups, valid ranges) and mac. A span's score starts from its kind's
prior; words of its kind within ``CONTEXT`` characters raise it, words that
speak against it lower it. Fixed kinds always stay; the others need
``LEAST`` points.

Defined results: null and empty texts have no spans; repeated rows get equal
spans; an empty table gives no rows; a very long text is searched in one pass
per kind; other columns are kept, and a column of the spans' name replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "mac")
CONTEXT, LEAST = 48, 0.5
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.8, "ssn": 0.35, "mac": 0.55}
#: Words near a span that speak for its kind, and words that speak against personal data.
FOR = {
    "email": r"e-?mail|contact|write to|correo|courriel",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|amex|credit|debit|karte|tarjeta|carte",
    "phone": r"phone|call|tel\b|fax|mobile|telefon|tel[eé]fono",
    "iban": r"iban|bank|konto|account|cuenta|compte",
    "ssn": r"ssn|social security|taxpayer",
    "mac": r"\bmac\b|device|adapter|interface",
}
AGAINST = re.compile(r"version|invoice|order no|isbn|example only|build|part number", re.I)
FOR_WORDS = {k: re.compile(v, re.I) for k, v in FOR.items()}

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
MAC = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
DIGIT = re.compile(r"[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    raw = iban.replace(" ", "")
    return 15 <= len(raw) <= 34 and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the address part is the run of its letters before a domain."""
    out, last = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def valid_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def proposed(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans of every kind, in the order of KINDS, then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    out += [("iban", *m.span()) for m in IBAN.finditer(text) if mod97(m[0])]
    if "-" in text:
        out += [("ssn", *m.span()) for m in SSN.finditer(text) if valid_ssn(m[0])]
    if ":" in text:
        out += [("mac", *m.span()) for m in MAC.finditer(text)]
    return out


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the spans that stay; positions in code points."""
    out = []
    for kind, a, b in proposed(text) if text else ():
        near = text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT]
        score = PRIOR[kind] + 0.25 * bool(FOR_WORDS[kind].search(near)) - 0.2 * bool(AGAINST.search(near))
        if kind in BASE_KINDS or score >= LEAST:
            out.append((kind, a, b, round(min(1.0, max(0.0, score)), 2)))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def with_spans(docs: DataFrame, column: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with an array of spans; a column of that name is replaced."""
    docs = docs.drop(name)
    fields = docs.schema.fields
    place, names = [f.name for f in fields].index(column), [*[f.name for f in fields], name]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    keys = ("kind", "start", "end", "score")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [[dict(zip(keys, s, strict=True)) for s in find(t)] for t in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=names)

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, SPANS)]))


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets."""
    if text is None:
        return None
    out, last = [], 0
    for kind, a, b, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
            last = b
    return "".join([*out, text[last:]])
