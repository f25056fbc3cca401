"""Operator 7: personal data. Expressions propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import in_arrow, packed, with_row

#: Kinds in the order in which results list them; the first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
KINDS = BASE + ADDED
#: Spans of the added kinds count from this score on.
MIN_SCORE = 0.5
#: Characters on either side in which context words count.
NEAR = 40
#: Characters that a secret's value has at least.
MIN_SECRET = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: the one before it would have taken the whole run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:(?-i:AKIA[A-Z0-9]{16})(?![A-Za-z0-9])"
    r"|(?-i:gh[pousr]_[A-Za-z0-9]{20,}+|xox[abeoprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+)"
    r"|bearer\x20{1,3}[A-Za-z0-9_.~+/-]{16,}+=*+"
    r"|(?:password|passwd|pwd|secret|token|api[_-]?key)\x20{0,3}[=:]\x20{0,3}[\"']?[A-Za-z0-9_/+.-]{%d,}+)"
    # a private key goes whole; the text in it holds no dashes, so nothing is looked through twice
    r"|(?-i:-----BEGIN [A-Z\x20]{0,30}PRIVATE KEY-----(?:[^-]|-(?!----))*+-----END [A-Z\x20]{0,30}PRIVATE KEY-----)" % MIN_SECRET, re.I)


def _words(words: str) -> re.Pattern:
    """Whole words only: ``part`` is not in ``department``; digits and underscores end a word too."""
    return re.compile(rf"(?<![^\W\d_])(?:{words})(?![^\W\d_])", re.I)


_CONTEXT = {
    "iban": _words("ibans?|accounts?|bank|banking|kontos?|cuentas?|comptes?"),
    "ssn": _words("ssns?|social|security|tax|taxes"),
    "secret": _words("keys?|secrets?|tokens?|pass|passwords?|passwd|login|logins|credentials?|authorization"),
}
_AGAINST = {
    "iban": _words("orders?|serials?|parts?"),
    "ssn": _words("orders?|invoices?|parts?|skus?|isbn"),
    "secret": _words("examples?|samples?|placeholders?|dummy"),
}
#: Score of a confirmed span without context. A number pattern without checksum needs a context word.
_START = {"iban": 0.8, "ssn": 0.3, "secret": 0.7}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @, left to the start of the run before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield first, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _matching(pattern: re.Pattern, valid: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if valid(m.group()))


def _small(s: str) -> bool:
    return all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in s.split("."))


_FIND = {
    "email": emails,
    "ip": _matching(_IP, _small),
    "card": _matching(_CARD, lambda s: 13 <= len(d := _digits(s)) <= 19 and luhn(d)),
    "phone": _matching(_PHONE, lambda s: 9 <= len(_digits(s)) <= 15),
    "iban": _matching(_IBAN, mod97),
    "ssn": _matching(_SSN, lambda s: True),
    "secret": _matching(_SECRET, lambda s: any(c.isdigit() for c in s)),
}
_DIGIT = re.compile("[0-9]")
_VALUE = re.compile(r"[=:]\x20{0,3}[\"']?")


def _left(text: str, a: int, b: int, over: list[tuple[int, int]]) -> int:
    """Characters of a secret's value that no span of ``over`` takes."""
    m = _VALUE.search(text, a, b)
    at, n = m.end() if m else a, 0
    for x, y in sorted(over):
        n += max(0, x - at)
        at = max(at, y)
    return n + max(0, b - at)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; positions in code points, end exclusive.

    Base kinds always have score 1. An added kind starts from its own score,
    gains 0.2 for a context word and loses 0.4 for a word against it within
    ``NEAR`` characters, and counts from ``MIN_SCORE`` on unless it overlaps a base span;
    a secret does all the same if ``MIN_SECRET`` characters of its value lie outside base spans.
    """
    if "@" not in text and not _DIGIT.search(text):
        return []
    base = [(k, a, b, 1.0) for k in BASE for a, b in _FIND[k](text)]
    more = []
    for k in ADDED:
        for a, b in _FIND[k](text):
            over = [(x, y) for _, x, y, _ in base if a < y and x < b]
            if over and (k != "secret" or _left(text, a, b, over) < MIN_SECRET):
                continue
            near = text[max(0, a - NEAR):a] + " " + text[b:b + NEAR]
            score = _START[k] + 0.2 * bool(_CONTEXT[k].search(near)) - 0.4 * bool(_AGAINST[k].search(near))
            if score >= MIN_SCORE:
                more.append((k, a, b, min(1.0, round(score, 3))))
    return base + more


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    out, end = [], 0
    for k, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{k}>"]
        end = max(end, b)
    return "".join(out) + text[end:] if out else text


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with two more columns: ``pii_spans`` and ``pii_text``, the text with spans replaced.

    Null texts have no spans and stay null, empty ones stay empty; repeated rows
    and other columns stay, but any of the two new names are replaced. Texts are
    scanned whole, each expression in linear time.
    """
    rows = packed(docs, text, ("pii_spans", "pii_text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(b: pa.RecordBatch):
        texts = b.column(1).to_pylist()
        found = [find(t) if t else [] for t in texts]
        spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in f] for f in found]
        clean = [redact(t, f) if f else t for t, f in zip(texts, found)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(spans, kind), pa.array(clean, pa.string())], ["row", "pii_spans", "pii_text"])

    return in_arrow(rows, run, with_row(rows, f"pii_spans {SPANS}, pii_text string")).select("row.*", "pii_spans", "pii_text")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_<base kind>..., base_sha256, spans): the spans of ``personal_data`` as counts, a digest and a list."""
    found = personal_data(docs.select(key, text), text)
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    of_kind = lambda k: F.filter("pii_spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(key, *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("pii_spans")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with the same columns, spans in ``text`` replaced and ``length``, if there is one, counted anew.

    Rows without spans keep both as they were, a wrong or null length included.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    found = personal_data(rows)
    new = {text: F.col("pii_text")}
    if length in docs.columns:
        kind = docs.schema[length].dataType
        old = F.col("row").getField(length)
        new[length] = F.when(F.size("pii_spans") > 0, F.length("pii_text").cast(kind)).otherwise(old)
    return found.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))
