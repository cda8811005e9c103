"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust a score.

The base kinds (email, ip, card, phone) follow fixed patterns and stay whatever their score.  The
method adds cards and phones that the base patterns lose in a longer run of digits, and kinds that
a pattern alone cannot decide: each proposal starts from a prior, a validator or a context word
near the span raises it, a word that speaks against it lowers it, and spans that reach the
threshold count.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, text_or_empty

#: The base patterns, in the order in which kinds are listed.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = [*BASE, "iban", "ssn", "national_phone", "secret"]

#: The ip pattern without its retries: where digits are followed by no dot, no later start in them fits either.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
#: Patterns of the kinds that the method adds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-]|[0-9]{3}[-. ])[0-9]{3,4}[-. ]?[0-9]{3,5}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?<![_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}+)(?![A-Za-z0-9_/+=-])")
_CARD = re.compile(r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9])")
_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,5}\)[ .-]?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){0,4}(?![0-9])")
PROPOSALS = {"card": _CARD, "phone": _PHONE, "iban": _IBAN, "ssn": _SSN, "national_phone": _NATIONAL}
#: Words near a span that speak for its kind, in the corpus's languages.
CONTEXT = {
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|telefon|telefono|teléfono|téléphone|call|mobile|cell|fax)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|transfer)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|tax id)\b"),
    "national_phone": re.compile(r"(?i)\b(?:phone|tel|telephone|telefon|telefono|teléfono|téléphone|call|mobile|cell|fax|handy|móvil)\b"),
    "secret": re.compile(r"(?i)\b(?:password|passwd|pwd|passwort|secret|token|api[_ -]?key|apikey|access[_ -]?key|credential|contraseña)s?\b\W{0,6}$"),
}
AGAINST = re.compile(r"(?i)\b(?:isbn|order|invoice|version|figure|table|page|commit|sha256|md5)\b")
#: Scores: what a pattern starts from, what each finding adds, and what a span needs.
PRIOR = {"card": 0.1, "phone": 0.2, "iban": 0.2, "ssn": 0.1, "national_phone": 0.3, "secret": 0.1}
VALID, NEAR, OPPOSED, NEEDED, WINDOW = 0.6, 0.5, -0.4, 0.6, 40


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def _base_holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))
    digits = _digits(found)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    """The email pattern's matches: at an at-sign, back over the run of local characters."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < at and (found := BASE["email"].match(text, start)):
            out.append(found.span())
            last = found.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost, non-overlapping matches of each base kind that hold, by start, then kind as listed."""
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in _emails(text)]
    if _ANY_DIGITS.search(text):
        for kind, pattern in (("ip", _IP), ("card", BASE["card"]), ("phone", BASE["phone"])):
            out += [(*m.span(), kind) for m in pattern.finditer(text) if _base_holds(kind, m.group())]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


_ANY_DIGITS = re.compile("[0-9]")


def score(kind: str, text: str, start: int, end: int, valid: bool) -> float:
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    near = CONTEXT[kind].search(before) or (kind != "secret" and CONTEXT[kind].search(after))
    return PRIOR[kind] + VALID * valid + NEAR * bool(near) + OPPOSED * bool(AGAINST.search(before))


def _valid(kind: str, found: str) -> bool:
    if kind in ("card", "phone"):
        return _base_holds(kind, found)
    if kind == "iban":
        return mod97(found.replace(" ", ""))
    if kind == "ssn":
        area, group, serial = found.split("-")
        return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    if kind == "secret":
        return found.startswith(("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"))
    return False


def added_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the added kinds that reach the threshold and touch no base span, nor an earlier one."""
    proposed = []
    if _ANY_DIGITS.search(text):
        proposed += [(kind, m) for kind, pattern in PROPOSALS.items() for m in pattern.finditer(text)]
    if CONTEXT_WORD.search(text) or "AKIA" in text or "gh" in text:
        proposed += [("secret", m) for m in _SECRET.finditer(text)]
    if not proposed:
        return []
    out, covered = [], bytearray(len(text))  # a byte of each character: whether a span has it
    for a, b, _ in taken:
        covered[a:b] = b"\1" * (b - a)
    for kind, m in proposed:
        a, b = m.span()
        if covered.find(1, a, b) < 0 and score(kind, text, a, b, _valid(kind, m.group())) >= NEEDED:
            out.append((a, b, kind))
            covered[a:b] = b"\1" * (b - a)
    return out


CONTEXT_WORD = re.compile(r"(?i)passw|pwd|secret|token|key|credential|contraseña")


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: (start, end, kind), end exclusive, in code points."""
    base = base_spans(text)
    added = added_spans(text, base)
    return base, sorted([*base, *added], key=lambda x: (x[0], KINDS.index(x[2]))) if added else base


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of base kinds, their digest, and all spans.

    Null and empty texts have no spans and the digest of nothing.  Time and memory grow in
    proportion to a text's length, however many spans it has.  Spans of several kinds that begin
    together stand in the order of the kinds.  Repeated rows each give a row; an empty table gives
    none; other columns are ignored, whatever their names.  Nothing is shuffled.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [spans(text) for text in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(x[2] == kind for x in base) for base, _ in found], pa.int64()) for kind in BASE]
            columns.append(pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]))
            columns.append(pa.array([_joined(every) for _, every in found], pa.string()))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{kind}" for kind in BASE), "base_sha256", "spans"])

        return step

    return map_rows(docs.select("doc_id", text_or_empty()), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with a tag in the place of each span; of overlapping spans the first, then the longer, names it."""
    _, every = spans(text)
    if not every:
        return text
    out, last = [], 0
    merged: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(every, key=lambda x: (x[0], -x[1])):
        if merged and a < merged[-1][1]:
            x, y, first = merged[-1]
            merged[-1] = (x, max(y, b), first)
        else:
            merged.append((a, b, kind))
    for a, b, kind in merged:
        out += [text[last:a], f"<{kind}>"]
        last = b
    return "".join([*out, text[last:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted texts, all other columns as they are; a null text stays null, an empty one empty.

    Repeated rows stay repeated; an empty table stays empty.
    """
    names, types = docs.columns, dict(docs.dtypes)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if t is None else redacted(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

        return step

    return map_rows(docs, make, ", ".join(f"`{c}` {types[c]}" for c in names))
