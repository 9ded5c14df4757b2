"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

All patterns are ASCII and are matched on the bytes of the whole text, without
retries: a proposed span that fails its check is dropped and the search goes
on behind it, or for an IBAN at its next group.  Quantifiers are possessive or the span is grown by hand, so a
long run of characters is read once, not once for each start.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import store
from tessera.llm.blocks import documents
from tessera.llm.spans import Span, digest, in_code_points, joined, ordered

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_DIGIT = re.compile(rb"[0-9]")
_NOT_DIGIT = re.compile(rb"[^0-9]+")

# The total length of an IBAN by country, all of the registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}
_WHOLE = {n: re.compile(rb"[A-Z0-9](?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 1)) for n in set(IBAN_LENGTHS.values())}

# Scores in percent: what the pattern alone, or the pattern and its checksum, are worth.
START_SCORE = {"email": 80, "ip": 50, "card": 70, "phone": 50, "iban": 85}
NEAR = 48  # bytes before and after a span that are searched for context words
BONUS, MALUS = 15, 30
# Whole words, with the endings and compounds that these languages give them ("hotel" holds no "tel", "latest" no "test").
_CONTEXT = {
    "email": re.compile(rb"\b(?:e-?mails?|contacts?|kontakt|correo|courriel|write to)\b"),
    "ip": re.compile(rb"\b(?:ip|servers?|hosts?|address(?:es)?|adresse)\b"),
    "card": re.compile(rb"\b(?:cards?|\w*karten?|cartes?|tarjetas?|visa|payments?|credit)\b"),
    "phone": re.compile(rb"\b(?:(?:tele|mobil)?phones?|tel|\w*telefon\w*|t\xc3\xa9l\w*|calls?|fax|mobile?|anruf)\b"),
    "iban": re.compile(rb"\b(?:iban|accounts?|\w*konto|comptes?|cuentas?|banks?)\b"),
}
_DOUBT = re.compile(rb"\b(?:examples?|samples?|dummy|placeholders?|versions?|tests?)\b")
_CUT_START, _CUT_END = re.compile(rb"^\w+"), re.compile(rb"\w+$")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(raw: bytes) -> list[Span]:
    out, done = [], 0
    for m in _DOMAIN.finditer(raw):
        at = a = m.start()
        while a > done and raw[a - 1] in _LOCAL:
            a -= 1
        if a < at:
            out.append((a, m.end(), "email"))
            done = m.end()
    return out


def _ibans(raw: bytes) -> list[Span]:
    """Every start of a group is tried, so neither a leading code nor a preceding IBAN hides one."""
    out, done = [], 0
    for start in _IBAN.finditer(raw):
        size = IBAN_LENGTHS.get(start[0][:2].decode())
        m = size and start.start() >= done and _WHOLE[size].match(raw, start.start())
        if m and mod97(m[0].replace(b" ", b"").decode()):
            out.append((*m.span(), "iban"))
            done = m.end()
    return out


def find(raw: bytes) -> list[Span]:
    """All confirmed spans of a text, in bytes."""
    out = _emails(raw) if b"@" in raw else []
    if not _DIGIT.search(raw):
        return out
    for m in _IP.finditer(raw):
        parts = [p.lstrip(b"0") or b"0" for p in m[0].split(b".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(raw):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub(b"", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if b"+" in raw:
        for m in _PHONE.finditer(raw):
            if 9 <= len(_NOT_DIGIT.sub(b"", m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return out + _ibans(raw)


def score(raw: bytes, span: Span) -> int:
    """Percent: the kind's own worth, more with a word of its kind nearby, less with a word of doubt."""
    a, b, kind = span
    left, right = raw[max(0, a - NEAR):a], raw[b:b + NEAR]
    if a > NEAR:  # a word that the edge may have cut says nothing
        left = _CUT_START.sub(b"", left)
    if b + NEAR < len(raw):
        right = _CUT_END.sub(b"", right)
    near = (left + b" " + right).lower()
    s = START_SCORE[kind] + BONUS * bool(_CONTEXT[kind].search(near)) - MALUS * bool(_DOUBT.search(near))
    return max(0, min(100, s))


def _scan(batches):
    for b in batches:
        counts, base, every, scores = {k: [] for k in KINDS}, [], [], []
        for raw in documents(b.column(1)):
            found = ordered(find(raw), KINDS)
            for k in KINDS:
                counts[k].append(sum(s[2] == k for s in found))
            scores.append(",".join(str(score(raw, s)) for s in found))
            found = in_code_points(raw, found)
            base.append(digest([s for s in found if s[2] in BASE]))
            every.append(joined(found))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base, pa.string()),
             pa.array(every, pa.string()), pa.array(scores, pa.string())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "scores"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, n_iban, base_sha256, spans, scores.

    Spans are kind:start:end in code points, by start and then kind, joined by
    commas; ``base_sha256`` digests those of the four base kinds, ``scores``
    has the percent of each span of ``spans``.  Null and empty texts have
    none.  Nothing is shuffled.
    """
    store.prepare(docs.sparkSession)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
        *(T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", "scores"))])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, schema)
