"""Personal data (operator 9): patterns propose spans, checksums confirm them, context words adjust a score.

Each text is read once, as a whole, by the task that holds it: no shuffle, and work in proportion to
the text however long a run of letters or digits in it is. Offsets count code points, ends are exclusive.

* Base kinds. ``email``, ``ip``, ``card`` and ``phone`` are the leftmost non-overlapping matches of their
  patterns; a match that fails its check (parts over 255, Luhn, number of digits) is dropped and the
  search goes on behind it. Base spans always stay.
* Added kinds. ``iban`` needs the mod-97 checksum, ``ssn`` (ddd-dd-dddd) a plausible number. Both
  start from a score that words nearby raise or lower, and stay at ``threshold`` or more.

A null text has no span and stays null when redacted; an empty text has none. Rows are independent, so
ties, repeated rows and null identifiers need no rule. Columns beside the text pass through unchanged;
a result column whose name the frame already has gets leading underscores.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintageline.llm.common import free_name, slices

# Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

# Words that make a number nearby more, or less, likely to be personal.
SUPPORTING = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
OPPOSING = ("version", "isbn", "order", "invoice", "example", "sample", "test", "page", "chapter")
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}

SPAN_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)

_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match that begins inside a run of digits would have begun at the run's start, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CONTEXT_WORD = re.compile(r"[^\W\d_](?:[^\W_]|-(?=[^\W_]))*")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether country code and check digits, moved to the end and read as a number, leave 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(match: str) -> str:
    return "".join(c for c in match if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ signs: only the run before an @ can begin one."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL_TAIL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        else:
            # What lies before a failed @ begins no later match.
            free = at + 1
        at = text.find("@", free)


def _valid_ip(match: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in match.split("."))


def _valid_card(match: str) -> bool:
    digits = _digits(match)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _valid_ssn(match: str) -> bool:
    area, group, serial = match.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest checksummed prefix of a proposal, cut at its blanks; the search goes on where it ends."""
    found = _IBAN.search(text)
    while found:
        ends = [found.end(), *(found.start() + k for k, c in enumerate(found.group()) if c == " ")]
        following = found.end()
        for end in sorted(ends, reverse=True):
            compact = text[found.start() : end].replace(" ", "")
            if 15 <= len(compact) <= 34 and mod97(compact):
                yield found.start(), end
                following = end
                break
        found = _IBAN.search(text, following)


def context_score(text: str, kind: str, start: int, end: int, reach: int = 60) -> float:
    """Start value of the kind, raised by a supporting word within ``reach`` characters, lowered by an opposing one."""
    around = text[max(0, start - reach) : start] + " " + text[end : end + reach]
    words = {w.lower() for w in _CONTEXT_WORD.findall(around)}
    score = START_SCORE[kind]
    score += 0.3 * any(w in words for w in SUPPORTING[kind])
    score -= 0.2 * any(w in words for w in OPPOSING)
    return round(min(1.0, max(0.0, score)), 3)


def find_spans(text: str | None, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    """All spans of one text as (kind, start, end, score), by start, then kind as listed."""
    if not text:
        return []
    found = [("email", *span) for span in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _valid_ip(m.group())]
    found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if _valid_card(m.group())]
    found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    found += [("iban", *span) for span in _ibans(text)]
    found += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text) if _valid_ssn(m.group())]
    scored = [(kind, start, end, context_score(text, kind, start, end)) for kind, start, end in found]
    kept = [s for s in scored if s[0] in BASE_KINDS or s[3] >= threshold]
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, free = [], 0
    for kind, start, end, _ in spans:
        if start >= free:
            out += [text[free:start], f"<{kind.upper()}>"]
        free = max(free, end)
    return "".join([*out, text[free:]])


def pii_spans(documents: DataFrame, text: str = "text", threshold: float = 0.6) -> DataFrame:
    """Each row with ``spans`` (kind, start, end, score) and ``redacted``, the text without them."""
    spans_name, redacted_name = free_name(documents.columns, "spans"), free_name(documents.columns, "redacted")
    schema = T.StructType(
        [*documents.schema.fields, T.StructField(spans_name, SPAN_TYPE), T.StructField(redacted_name, T.StringType())]
    )
    place = documents.columns.index(text)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            spans = [find_spans(t, threshold) for t in texts]
            clean = [redacted(t, s) if s else t for t, s in zip(texts, spans)]
            rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in found] for found in spans]
            columns = [*batch.columns, pa.array(rows, ARROW_SPANS), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, spans_name, redacted_name])

    return documents.mapInArrow(scan, schema)


def spelled(spans) -> Column:
    """The spans as kind:start:end, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind))


def pii_digest(documents: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans, per document."""
    found = pii_spans(documents.select("doc_id", "text")).drop("text", "redacted")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    counts = [_count(kind).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )
