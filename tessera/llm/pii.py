"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Every pattern is driven from an anchor (an ``@``, a maximal digit run, a ``+``), so the work is linear in
the text however long its words are. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import map_arrow

#: Fixed order of the base kinds, then those the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "local_phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Length of an account number by country.
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\)[\x20]?|0)[0-9]{2,4}[\x20./-][0-9]{3,4}(?:[\x20./-]?[0-9]{2,4})?(?![0-9.-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Words near a span that speak for its kind, and words that speak against personal data.
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "call", "tel", "mobile", "telefon", "fax"),
}
AGAINST = ("version", "isbn", "order", "section", "figure", "build")
#: Score without context. Kinds without a checksum need a context word to reach THRESHOLD.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "local_phone": 0.3}
THRESHOLD = 0.5
REACH = 40
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an account number: country and check digits moved to the end, letters as 10..35."""
    rest = 0
    for c in code[4:] + code[:4]:
        n = int(c, 36)
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Dotted digit runs taken four parts at a time from the left; parts over 255 fail."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p) <= 255 or len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """What follows a number may look like more of it (a BIC, a date): the country's length is tried first, then
    the whole match; for a country without a known length every end of a group, the longest first."""
    m = _IBAN.search(text)
    while m:
        start, whole = m.start(), m.group()
        ends = [k for k in range(len(whole), 14, -1) if whole[k - 1] != " " and (k == len(whole) or whole[k] == " ")]
        length = _IBAN_LENGTH.get(whole[:2])
        if length:
            ends = [k for k in ends if k - whole.count(" ", 0, k) == length] + ends[:1]
        end = next((start + k for k in ends if k - whole.count(" ", 0, k) >= 15 and mod97(whole[:k].replace(" ", ""))), None)
        if end:
            yield start, end
        m = _IBAN.search(text, end or start + 1)


def numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_NOT_DIGIT.sub("", m.group())) <= 13:
            yield m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, moved up by a context word within ``REACH`` characters and down by a counter word."""
    near = set(_WORD.findall((text[max(0, start - REACH):start] + " " + text[end:end + REACH]).lower()))
    value = PRIOR[kind] + 0.3 * bool(near.intersection(CONTEXT[kind])) - 0.3 * bool(near.intersection(AGAINST))
    return min(1.0, max(0.0, value))


def find(text: str) -> tuple[list[tuple[str, int, int, float]], list[tuple[str, int, int, float]]]:
    """Base spans (all of them, with their score) and added spans that reach the threshold and overlap none."""
    base: list = []
    digits = _DIGIT.search(text) is not None
    found = {"email": emails(text) if "@" in text else (), "ip": addresses(text) if digits else (),
             "card": cards(text) if digits else (), "phone": phones(text) if digits else ()}
    for kind in BASE_KINDS:
        base += [(kind, s, e, score(text, kind, s, e)) for s, e in found[kind]]
    more: list = []
    if digits:
        taken = sorted((s, e) for _, s, e, _ in base)
        for kind, proposed in zip(MORE_KINDS, (ibans(text), numbers(text), local_phones(text)), strict=True):
            for s, e in proposed:
                value = score(text, kind, s, e)
                k = bisect_left(taken, (e, 0))
                if value >= THRESHOLD and (k == 0 or taken[k - 1][1] <= s):
                    more.append((kind, s, e, value))
                    taken.insert(k, (s, e))
    return base, more




SPANS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (
    ("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("score", T.DoubleType()), ("value", T.StringType()), ("base", T.BooleanType()))]))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) for every input row: kind, start, end, score, matched text and whether it is a base span.

    Base kinds come first in their order, each by start, then the added kinds. A null or empty text has no
    spans; repeated rows give repeated results; no other column is read.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("spans", SPANS)])

    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                                  ("value", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a span holds a digit or an at sign; other texts need not become Python strings
            column = batch.column("text")
            likely = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_pylist()
            out = []
            for i, yes in enumerate(likely):
                if not yes:
                    out.append([])
                    continue
                t = column[i].as_py()
                base, more = find(t)
                out.append([{"kind": k, "start": s, "end": e, "score": v, "value": t[s:e], "base": b}
                            for rows, b in ((base, True), (more, False)) for k, s, e, v in rows])
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, kind_of)], names=["doc_id", "spans"])

    return map_arrow(source, run, fields)


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans as text, and the score of each, as its context left it."""
    base = F.filter("spans", lambda s: s["base"])

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = map(of_kind, BASE_KINDS)
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"))
