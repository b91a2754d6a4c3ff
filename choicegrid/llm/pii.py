"""Personal data in texts: regexes propose spans, checksums confirm them, words nearby adjust their scores.

Base spans follow four fixed grammars, whole matches only. What the grammars lose is proposed again in smaller pieces: a
card number or a phone number that runs into other digits is cut at its groups and confirmed by issuer, Luhn and length;
bank accounts are confirmed by mod 97, IPv6 addresses by their grammar; national phone numbers, social security numbers and
mail addresses spelled out need a word nearby or brackets. Every regex is linear in a text: repeats are possessive or
bounded, and the part of an address before its @ is found from the @ backwards.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: The first four have base spans.
BASE = KINDS[:4]
#: Added spans need this score.
LEAST = 0.6
#: Code points before and behind a span in which words count.
BEFORE, BEHIND = 40, 20

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
AT_HOST = re.compile(f"@{HOST}")
# a match of the dotted or grouped numbers always begins where a run of digits does
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SPELLED_AT = re.compile(r"(?: ?[\[({] ?(?:at|arroba) ?[\])}] ?)(?=[A-Za-z0-9])(?:[A-Za-z0-9-]++(?: ?[\[({] ?(?:dot|punto|punkt|point) ?[\])}] ?|\.)){1,4}[A-Za-z0-9-]++", re.IGNORECASE)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+(])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,4}){2,5}(?![0-9A-Za-z])")
DIGITS = re.compile(r"[0-9]+")
WORD = re.compile(r"[^\W\d_]+")

#: Characters of an account number by its country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: Digits of a card number by what it begins with.
ISSUERS = [
    (re.compile("4"), (13, 16, 19)), (re.compile("5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)"), (16,)), (re.compile("3[47]"), (15,)), (re.compile("3(?:0[0-5]|[68])"), (14, 16)),
    (re.compile("6(?:011|5|4[4-9])"), (16, 19)), (re.compile("35(?:2[89]|[3-8])"), (16, 19)), (re.compile("62"), (16, 17, 18, 19)), (re.compile("(?:50|5[6-8]|6[37])"), (16, 18, 19)),
]
#: Digits of a card's groups as they are printed.
PRINTED = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}

#: Words (English, German, French, Spanish) that speak for a kind, and words that speak against it.
FOR = {
    "email": "email mail contact write mailto kontakt schreiben courriel écrire correo contacto escriba".split(),
    "ip": "ip ipv host server address adresse serveur servidor dirección login".split(),
    "card": "card visa mastercard amex credit payment karte kreditkarte zahlung carte paiement crédit tarjeta crédito pago".split(),
    "phone": "phone tel call mobile fax cell whatsapp telefon handy anrufen ruf rufnummer téléphone tél appelez portable teléfono móvil llame llamar".split(),
    "iban": "iban account bank bic konto compte banque cuenta banco".split(),
    "ssn": "ssn social security".split(),
}
AGAINST = {"ip": "version release build section chapter abschnitt kapitel versión capítulo".split(), "card": "isbn order tracking bestellnummer commande pedido".split(), "phone": "isbn version".split()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number of letters and digits leaves 1, its first four characters moved to its end."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def issued(digits: str) -> bool:
    """Whether an issuer gives numbers that begin so and have so many digits."""
    return any(len(digits) in lengths and prefix.match(digits) for prefix, lengths in ISSUERS)


def only_digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def context(text: str, kind: str, start: int, end: int) -> float:
    """What the words near a span add to its score."""
    words = {w.lower() for w in WORD.findall(text[max(0, start - BEFORE) : start]) + WORD.findall(text[end : end + BEHIND])}
    return 0.3 * (not words.isdisjoint(FOR[kind])) - 0.4 * (not words.isdisjoint(AGAINST.get(kind, ())))


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    least = 0
    for m in AT_HOST.finditer(text):
        before = text[least : m.start()]
        local = len(before) - len(before.rstrip(LOCAL))
        if local:
            yield m.start() - local, m.end()
        least = m.end() if local else m.start() + 1


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost matches of the fixed grammars that hold as a whole; failing ones are passed over."""
    for start, end in base_emails(text):
        yield "email", start, end
    for m in DOTTED.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in GROUPED.finditer(text):
        digits = only_digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PLUS.finditer(text):
        if 8 <= len(only_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()


def groups(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in DIGITS.finditer(text, start, end)]


def cards_in(text: str) -> Iterator[tuple[int, int, float]]:
    """Card numbers of whole groups within grouped digits, the surest first where several overlap."""
    for m in GROUPED.finditer(text):
        if len(m[0]) < 13:
            continue
        if text[m.start() - 1 : m.start()].isalpha() or text[m.end() : m.end() + 1].isalpha():
            continue
        parts, found = groups(text, *m.span()), []
        for i in range(len(parts)):
            digits = ""
            for j in range(i, len(parts)):
                digits += text[slice(*parts[j])][: 20 - len(digits)]
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and issued(digits) and luhn(digits):
                    printed = i == j or tuple(b - a for a, b in parts[i : j + 1]) in PRINTED
                    found.append((parts[i][0], parts[j][1], 0.5 + 0.2 * printed))
        for start, end, score in sorted(found, key=lambda x: (-x[2], x[0], -x[1])):
            if not any(a < end and start < b for a, b, s in found if (-s, a, -b) < (-score, start, -end)):
                yield start, end, score


def phones_in(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, float]]:
    """Phone numbers with + that end at a group of digits before the match does: before another confirmed span, or where the country's numbers end."""
    for m in PLUS.finditer(text):
        ends, n = [], 0
        stop = min((a for a, _ in taken if m.start() < a < m.end()), default=m.end())
        for a, b in groups(text, *m.span()):
            n += b - a
            if n > 15 or b > stop:
                break
            if n >= 8:
                ends.append((n, b))
        north = [b for n, b in ends if n == 11 and text[m.start() + 1] == "1"]
        if north:
            yield m.start(), north[0], 0.9
        elif ends:
            yield m.start(), ends[-1][1], 0.7


def added_spans(text: str, base: list[Span]) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, score without context) of what the fixed grammars don't give."""
    least = 0
    for m in SPELLED_AT.finditer(text):
        before = text[least : m.start()]
        local = len(before) - len(before.rstrip(LOCAL))
        least = m.end()
        if 0 < local <= 64:
            yield "email", m.start() - local, m.end(), 0.7
    if not DIGITS.search(text):
        return
    for m in COLONS.finditer(text):
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        filled = len([p for p in m[0].split(":") if p])
        yield "ip", m.start(), m.end(), 0.9 if filled == 8 else 0.6 if filled >= 3 else 0.4
    for m in IBAN.finditer(text):
        account, end = "", m.start()
        wanted = IBAN_LENGTHS.get(m[0][:2], 99)
        while len(account) < wanted and end < m.end():
            account += text[end] if text[end].isalnum() else ""
            end += 1
        if len(account) == wanted and not text[end : end + 1].isalnum() and mod97(account):
            yield "iban", m.start(), end, 0.9
    cards = list(cards_in(text))
    for start, end, score in cards:
        yield "card", start, end, score
    taken = sorted([(s.start, s.end) for s in base if s.kind != "phone"] + [(a, b) for a, b, score in cards if score >= LEAST])
    phones = list(phones_in(text, taken))
    for start, end, score in phones:
        yield "phone", start, end, score
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000":
            yield "ssn", m.start(), m.end(), 0.4
    taken += [(s.start, s.end) for s in base if s.kind == "phone"] + [(a, b) for a, b, _ in phones]
    for m in NATIONAL.finditer(text):
        if 7 <= len(only_digits(m[0])) <= 12 and not SSN.fullmatch(m[0]) and not any(a < m.end() and m.start() < b for a, b in taken):
            yield "phone", m.start(), m.end(), 0.4


def find_spans(text: str, least: float = LEAST) -> list[Span]:
    """Base spans, and added ones with a score of at least `least`, by kind, start and end. Places are code points."""
    base = [Span(kind, a, b, round(min(1.0, max(0.0, (0.9 if kind in ("email", "card") else 0.7) + context(text, kind, a, b))), 3), True) for kind, a, b in base_spans(text)]
    seen, out = {s[:3] for s in base}, list(base)
    for kind, a, b, score in added_spans(text, base):
        score = round(min(1.0, max(0.0, score + context(text, kind, a, b))), 3)
        if score >= least and (kind, a, b) not in seen:
            seen.add((kind, a, b))
            out.append(Span(kind, a, b, score, False))
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def find(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, spans (kind, start, end, score, base) of every row of docs (doc_id, text), by kind, start and end.

    A null or empty text has no spans; texts of any length are read whole in time that grows with their length. Rows that
    repeat and null doc_ids are kept, other columns passed over; an empty table gives no rows. Spans of different kinds may
    overlap; a base span stays whatever its score.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                found = [[s._asdict() for s in find_spans(t or "", least)] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind string, start long, end long, score double, base boolean>>")


def redacted(text: str, least: float = LEAST) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for s in sorted(find_spans(text, least), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, text of every row of docs with personal data replaced; a null text stays null."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                texts = [t if t is None else redacted(t, least) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256 and spans as kind:start:end of every row of docs."""
    base = F.filter("spans", lambda s: s.base)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return find(docs).select("doc_id", *map(count, BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
