"""Personal data: patterns propose spans, validators confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns that pass their validator:
parts of at most 255, Luhn, number of digits. They stay whatever their score. The method adds two kinds: iban, confirmed by
mod-97, and ssn, whose digits are confirmed by a word nearby. Every pattern is run so that the time is linear in the text,
whatever the text: an address is sought from its @ outwards, and runs of digits are entered at their first digit only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NOT_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: Score of a validated span by kind, what a context word nearby adds, and the score from which an added span counts.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
NEARBY, CONTEXT_GAIN, ENOUGH = 60, 0.3, 0.6
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write to", re.I),
    "ip": re.compile(r"\bip\b|address|host|server", re.I),
    "card": re.compile(r"card|visa|credit|debit|payment", re.I),
    "phone": re.compile(r"phone|tel\b|call|mobile|fax", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"\bssn\b|social security", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the country and check digits go to the end, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in NOT_LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def spans(text: str) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) by start, then by KINDS."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    found += [(m.start(), 4, m.end()) for m in IBAN.finditer(text) if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x)]
    if "-" in text:
        found += [(m.start(), 5, m.end()) for m in SSN.finditer(text)]
    out = []
    for start, k, end in sorted(found):
        kind = KINDS[k]
        near = f"{text[max(0, start - NEARBY) : start]} {text[end : end + NEARBY]}"
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * bool(CONTEXT[kind].search(near)))
        if k < len(BASE) or score >= ENOUGH:
            out.append((start, kind, end, score))
    return out


COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, max_score double"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and COLUMNS, one row for each row given: spans holds kind:start:end (code points, end exclusive), comma-joined.

    A null text counts as empty: no spans, and the digest of the empty string. Rows repeat as given, null doc_ids stay null,
    other columns are not read. An empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows = []
            for text in b.column(1).to_pylist():
                got = spans(text) if text else []
                base = [x for x in got if x[1] in BASE]
                said = lambda xs: ",".join(f"{k}:{s}:{e}" for s, k, e, _ in xs)
                rows.append((*(sum(x[1] == k for x in base) for k in BASE), hashlib.sha256(said(base).encode()).hexdigest(), said(got), len(got), max((x[3] for x in got), default=0.0)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *(x.split()[0] for x in COLUMNS.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, {COLUMNS}")


def redact(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """docs with each span of its text replaced by its kind; overlapping spans are replaced as one, by the kind that starts first, of ties the one first in KINDS.

    Null and empty texts stay as they are; other columns keep their values, whatever they are called; repeated rows give equal
    rows; an empty table gives an empty table.
    """

    @F.pandas_udf("string")
    def run(texts):
        def one(text):
            if not text:
                return text
            out, at = [], 0
            for start, kind, end, _ in spans(text):
                if start >= at:
                    out += [text[at:start], mark.format(kind.upper())]
                at = max(at, end)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", run("text"))
