"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust their scores.

Each kind has a pattern, a prior, a validator and words that speak for it or against it when they stand
within ``NEAR`` characters. A proposal's score is its prior, plus what its validator adds (a failed
validator drops it), plus ``FOR`` if a word for its kind is near, minus ``AGAINST`` if only words against
it are. Proposals with a score of ``LEAST_SCORE`` or more are spans.

The four base kinds (``email``, ``ip``, ``card``, ``phone``) are found leftmost and not overlapping, each
by itself; what fails its check is dropped and not tried again in a shorter form; what passes stays
whatever stands near it, its score only says how sure it is. The further kinds (``FURTHER``) are added
where they overlap neither a base span nor one another: an earlier kind of the table goes first, then
the span that starts first.

All patterns take time in proportion to a text, whatever is in it: runs are entered at their first
character and taken whole, repetitions that may fail are bounded.

Edge cases: a null or empty text has no spans; places are code points of the whole text, end exclusive;
repeated rows are treated alike, each on its own; a null id stays null; very long texts are searched
whole, in memory whole; an empty table gives an empty result; other columns, whatever their names,
aren't carried by ``find_spans`` and are left as they are by ``redacted``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEAR = 48
FOR, AGAINST = 0.3, 0.3
LEAST_SCORE = 0.5
BASE = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


class Kind(NamedTuple):
    """``check`` gives what the validator adds to the score, or None where it fails."""

    name: str
    prior: float
    check: Callable[[str], float | None]
    speaks_for: frozenset[str]
    speaks_against: frozenset[str]


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn checksum."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod_97(account: str) -> bool:
    """Whether an international bank account number has the remainder that its check digits promise."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(found: str) -> str:
    return re.sub(r"[^0-9]", "", found)


def _card(found: str) -> float | None:
    digits = _digits(found)
    return 0.5 if 16 <= len(digits) <= 19 and luhn(digits) else None


def _short_card(found: str) -> float | None:
    """Cards of 14 and 15 digits, by the issuers that have them."""
    digits = _digits(found)
    issued = len(digits) == 15 and digits[:2] in ("34", "37") or len(digits) == 14 and digits[:2] in ("36", "38")
    return 0.4 if issued and luhn(digits) else None


def _ip(found: str) -> float | None:
    return 0.3 if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split(".")) else None


def _phone(found: str) -> float | None:
    return 0.2 if 8 <= len(_digits(found)) <= 15 else None


def _iban(found: str) -> float | None:
    account = found.replace(" ", "")
    return 0.6 if 15 <= len(account) <= 34 and mod_97(account) else None


def _social(found: str) -> float | None:
    """Area, group and serial numbers that are never given out fail."""
    area, group, serial = re.split(r"[ -]", found)
    return 0.1 if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else None


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Words near a number, in English, French, German and Spanish.
_ORDERS = _words("order invoice isbn issn version tracking commande facture bestellung rechnung pedido factura sku serial")
KINDS = {
    k.name: k
    for k in (
        Kind("email", 0.9, lambda found: 0.0, _words("mail email contact courriel kontakt correo"), _words("example sample")),
        Kind("ip", 0.5, _ip, _words("ip host server address adresse serveur servidor login"), _words("version release build section kapitel")),
        Kind("card", 0.4, _card, _words("card visa mastercard credit carte karte kreditkarte tarjeta debit cvv"), _ORDERS),
        Kind("phone", 0.6, _phone, _words("phone call tel telephone mobile fax téléphone telefon anruf teléfono móvil"), _ORDERS),
        Kind("iban", 0.3, _iban, _words("iban account bank konto compte cuenta bic"), _ORDERS),
        Kind("short_card", 0.2, _short_card, _words("card amex diners credit carte karte kreditkarte tarjeta"), _ORDERS),
        Kind("social", 0.2, _social, _words("ssn social security taxpayer"), _ORDERS),
        Kind("local_phone", 0.2, _phone, _words("phone call tel telephone mobile fax téléphone telefon anruf teléfono móvil"), _ORDERS),
    )
}

#: Further kinds in the order in which they are added.
FURTHER = {
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "short_card": re.compile(r"(?<![0-9])3[4678](?:[ -]?[0-9]){12,13}(?![0-9])"),
    "social": re.compile(r"(?<![0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4})(?![0-9-])"),
    "local_phone": re.compile(r"(?<![0-9+.-])\(?0?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9-])"),
}

_LOCAL = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUADS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` with a domain back over its local part; a pattern that begins with the local part would try each of its ends."""
    free = 0
    for found in _DOMAIN.finditer(text):
        before = text[free : found.start()]
        before = before[before.rfind("@") + 1 :]
        size = len(before) - len(before.rstrip(_LOCAL))
        if size:
            yield found.start() - size, found.end()
            free = found.end()
        else:
            free = max(free, found.start())


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Numbers between dots, four at a time from the first of a row of them."""
    for found in _QUADS.finditer(text):
        parts, at = found.group().split("."), found.start()
        for i in range(0, len(parts) - 3, 4):
            size = len(".".join(parts[i : i + 4]))
            yield at, at + size
            at += size + 1


def _proposed(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        return _emails(text) if "@" in text else iter(())
    if kind == "ip":
        return _addresses(text)
    if kind == "phone" and "+" not in text:
        return iter(())
    pattern = {"card": _CARD, "phone": _PHONE}.get(kind) or FURTHER[kind]
    return (found.span() for found in pattern.finditer(text))


def _near(text: str, start: int, end: int) -> set[str]:
    """Words near a span; those that the window cuts lose what lies outside."""
    return {w.lower() for part in (text[max(0, start - NEAR) : start], text[end : end + NEAR]) for w in _WORD.findall(part)}


def _scored(kind: Kind, text: str, start: int, end: int) -> float | None:
    added = kind.check(text[start:end])
    if added is None:
        return None
    near = _near(text, start, end)
    context = FOR if near & kind.speaks_for else -AGAINST if near & kind.speaks_against else 0.0
    return round(min(1.0, max(0.0, kind.prior + added + context)), 3)


def spans_of(text: str | None) -> list[Span]:
    """The spans of a text: base kinds as listed, then further ones, each by its start."""
    if not text:
        return []
    spans = []
    for name in BASE:
        for start, end in _proposed(name, text):
            score = _scored(KINDS[name], text, start, end)
            if score is not None:
                spans.append(Span(name, start, end, score))
    taken = sorted((s.start, s.end) for s in spans)
    for name in FURTHER:
        added = []
        for start, end in _proposed(name, text):
            score = _scored(KINDS[name], text, start, end)
            if score is not None and score >= LEAST_SCORE:
                added.append(Span(name, start, end, score))
        added = _apart(added, taken)
        taken = sorted(taken + [(s.start, s.end) for s in added])
        spans += added
    return spans


def _apart(added: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Those of ``added`` that overlap none of ``taken``; both in order of their starts."""
    left, i, reach = [], 0, -1
    for span in added:
        while i < len(taken) and taken[i][0] < span.end:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= span.start:
            left.append(span)
    return left


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in spans_of(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["id", "spans"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id long, spans {SPANS}")


def _masked(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for span in sorted(spans_of(text), key=lambda s: (s.start, -s.end)):
        if span.start >= at:
            out += [text[at : span.start], f"<{span.kind.upper()}>"]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the name of its kind in place of each span; where spans overlap, of the one that starts first."""
    place = docs.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, T.StringType() if i == place else f.dataType) for i, f in enumerate(docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = pa.array([_masked(t.as_py()) for t in batch.column(place)], pa.string())
            yield batch.set_column(place, batch.schema.field(place).name, masked)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
