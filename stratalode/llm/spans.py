"""Spans (kind, start, end) in code points, end exclusive, and their digests.

``found`` orders a text's spans by start, then kind as listed.  The matchers
take linear time on any text: each run of characters is read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Span = tuple[str, int, int]

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def ordered(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    place = {k: i for i, k in enumerate(kinds)}
    return sorted(set(spans), key=lambda s: (s[1], place[s[0]], s[2]))


def rows(spans: Iterable[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans (of some kinds), comma-joined in their order."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


# The base patterns of secrets.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
# The base patterns of personal data.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
DIGIT = re.compile(r"[0-9]")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def secrets(text: str) -> list[Span]:
    """The base spans assign, access and hex."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if len(text) >= 32:
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of the e-mail pattern, one try for each run of local characters before an @.

    A match has one @, as neither side of the pattern can hold another, and
    starts at the leftmost local character before it that no match has taken.
    """
    out: list[Span] = []
    taken = 0
    for m in LOCAL.finditer(text):
        start = max(m.start(), taken)
        if start < m.end() - 1 and (domain := DOMAIN.match(text, m.end())):
            out.append(("email", start, domain.end()))
            taken = domain.end()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def personal(text: str) -> list[Span]:
    """The base spans email, ip, card and phone."""
    out = emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out
