"""Secret scan by assignment-aware lexing.

Each ``=``, ``:``, ``:=`` or ``=>`` of a text is tried as an assignment: the
name to its left (an identifier, a quoted key or a subscript) and the value to
its right (string literals, bare words and earlier names, joined by ``+``).
A type between ``:`` and ``=`` is passed over.  Values are resolved through the
names assigned before, so a literal is scored by every name that it reaches, also
across ``a = "…"; password = a + b``.  A literal that reaches a sensitive name and
looks like a secret becomes a span of kind ``literal``.  The base patterns give
``assign``, ``access`` and ``hex``.

A value is kept as what its score needs (length, counts of characters, beginning)
and references to its parts, never as text, and a literal that was found is not
visited again; so names and values of any length take linear time.

Defined results: null and empty texts have no spans; repeated rows repeat; texts
of any length are read whole; a literal's score is that of the first sensitive
name that it reaches with a score over the threshold.  A bare word before ``(`` is
a call.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalode.llm import spans as S
from stratalode.llm.runtime import map_text

KINDS = ("assign", "access", "hex", "literal")
#: Score from which a literal counts as a secret.
THRESHOLD = 1.0
#: Characters looked at first for the name before an operator; more where the name is longer.
NAME_LOOK = 264

OPERATOR = re.compile(r"=>|:=|=|:")
NAME_BACK = re.compile(r"[ \t]*[\]\)]?[\"']?([A-Za-z0-9_.\-]*[A-Za-z_])")  # over reversed text
NAME_RUN = re.compile(r"[ \t]*[\]\)]?[\"']?[A-Za-z0-9_.\-]*")  # what NAME_BACK may read
TYPE = re.compile(r"[ \t]*[&*]?(?:'\w+[ \t]+)?[A-Za-z_][\w.]*+(?:\[[^\[\]\n=:]*+\]|<[^<>\n=:]*+>)?\??(?:[ \t]*\|[ \t]*[A-Za-z_][\w.]*+)*+[ \t]*=(?![=>])")
PART = re.compile(r"""[ \t]*(?:[rbuf]{0,2}"((?:[^"\\\n]|\\.)*+)"|[rbuf]{0,2}'((?:[^'\\\n]|\\.)*+)'|((?:[A-Za-z0-9_./$@!%^&*~\-]|\+(?![ \t]*["']))++=*+)(?!\())""", re.DOTALL)
PLUS = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*|[ \t]+(?=[\"'])")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*\Z")

# Weights of the words of sensitive names, and of pairs of words.
NAME_WEIGHTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "authorization": 0.8}
PAIR_WEIGHTS = {("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("auth", "key"): 0.9, ("encryption", "key"): 0.9, ("signing", "key"): 0.9}
# Beginnings and whole values that stand for a secret without being one.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "****", "todo", "none", "null", "undefined", "${", "<")


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    single = max((NAME_WEIGHTS.get(w, 0.0) for w in words), default=0.0)
    return max([single, *(PAIR_WEIGHTS.get(p, 0.0) for p in zip(words, words[1:]))])


class Value:
    """What is known of a value: its length, character counts and beginning, and the literals or values it is made of.

    Characters beyond ASCII are counted in 128 classes.  Lengths and counts are
    scaled down beyond any that matter, as only their shares are used.
    """

    __slots__ = ("length", "counts", "start", "quoted", "parts", "found")

    def __init__(self):
        self.length, self.counts, self.start, self.quoted, self.parts, self.found = 0.0, {}, "", False, [], False

    def literal(self, a: int, b: int, s: str, quoted: bool) -> None:
        counts = Counter(s if s.isascii() else [c if c < "\x80" else chr(0x4E00 + ord(c) % 128) for c in s])
        self._add(len(s), counts, s[:START], quoted, (a, b))

    def value(self, other: Value) -> None:
        self._add(other.length, other.counts, other.start, other.quoted, other)

    def _add(self, length: float, counts: dict[str, float], start: str, quoted: bool, part) -> None:
        if len(self.start) < START and len(self.start) == self.length:
            self.start = (self.start + start)[:START]
        for c, n in counts.items():
            self.counts[c] = self.counts.get(c, 0.0) + n
        self.length += length
        self.quoted = self.quoted or quoted
        self.parts.append(part)
        if self.length > 1e12:
            self.length, self.counts = self.length / 1e3, {c: n / 1e3 for c, n in self.counts.items()}

    def score(self) -> float:
        """0 to 1: how much the value looks like a secret, from its length, entropy and kinds of characters."""
        spaces = sum(n for c, n in self.counts.items() if c.isspace())
        if self.length < 8 or self.start.lower().startswith(PLACEHOLDERS) or spaces == self.length:
            return 0.0
        entropy = -sum(n / self.length * math.log2(n / self.length) for n in self.counts.values())
        kinds = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "." for c in self.counts if not c.isspace()})
        score = min(1.0, entropy / 3.5) * (0.4 + 0.3 * min(kinds, 2) if self.quoted else 0.3 * min(kinds, 3) + 0.1)
        return score if not spaces or self.quoted and kinds >= 3 else 0.5 * score

    def literals(self):
        """The spans that no visit has given yet."""
        stack = [self]
        while stack:
            for part in stack.pop().parts:
                if isinstance(part, tuple):
                    yield part
                elif not part.found:
                    part.found = True
                    stack.append(part)


#: Characters of a value's beginning that are kept: more than any placeholder has.
START = 16


def name_before(text: str, at: int) -> str | None:
    """The identifier, quoted key or subscript that ends at ``at``, but for spaces."""
    look = NAME_LOOK
    while True:
        low = max(0, at - look)
        back = text[low:at][::-1]
        if not low or NAME_RUN.match(back).end() < len(back):
            found = NAME_BACK.match(back)
            return found.group(1)[::-1].strip("-.") if found else None
        look *= 4


def assignments(text: str):
    """(name, parts) of each assignment in order; a part is (start, end, text, quoted)."""
    at = 0
    while m := OPERATOR.search(text, at):
        at = m.end()
        if m.group() in ("=", ":") and text[at : at + 1] in ("=", ":", "/"):
            at += 1
            continue
        name = name_before(text, m.start())
        if name is None:
            continue
        if m.group() == ":" and (kind := TYPE.match(text, at)):
            at = kind.end()
        parts, end = [], at
        while part := PART.match(text, end):
            k = part.lastindex
            parts.append((part.start(k), part.end(k), part.group(k), k < 3))
            end = part.end()
            if not (plus := PLUS.match(text, end)):
                break
            end = plus.end()
        if parts:
            yield name, parts
        at = max(at, parts[0][1] if parts and parts[0][3] else at)


def literals(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name; score is name plus value, 0 to 2."""
    if "=" not in text and ":" not in text:
        return []
    env: dict[str, Value] = {}
    found: dict[tuple[int, int], float] = {}
    for name, parts in assignments(text):
        value = Value()
        for a, b, s, is_string in parts:
            known = [] if is_string else [env[x] for x in s.split("+") if x in env and IDENT.match(x)]
            if known:
                for other in known:
                    value.value(other)
            elif is_string or len(parts) == 1:
                value.literal(a, b, s, is_string)
        if not value.length:
            continue
        env[name] = value
        weight = name_score(name)
        if weight and (score := value.score()) >= 0.5 and weight + score >= threshold:
            for a, b in value.literals():
                if b > a:
                    found.setdefault((a, b), weight + score)
    return [(a, b, s) for (a, b), s in sorted(found.items())]


def scan(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, ``secret_spans`` and ``secret_score`` (the highest of the literals, else 0)."""

    def make():
        def one(text: str) -> tuple[list[dict], float]:
            found = literals(text, threshold)
            spans = S.ordered([*S.secrets(text), *(("literal", a, b) for a, b, _ in found)], KINDS)
            return S.rows(spans), max((s for _, _, s in found), default=0.0)

        return lambda texts: [list(x) for x in zip(*map(one, texts), strict=True)] if texts else [[], []]

    return map_text(docs, [T.StructField("secret_spans", S.SPANS), T.StructField("secret_score", T.DoubleType())], make, text_col)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in the texts replaced by ``mask``; null texts become empty."""

    def make():
        def one(text: str) -> str:
            cuts = sorted([(a, b) for _, a, b in S.secrets(text)] + [(a, b) for a, b, _ in literals(text)])
            out, at = [], 0
            for a, b in cuts:
                if a >= at:
                    out += [text[at:a], mask]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return lambda texts: [[one(x) for x in texts]]

    return map_text(docs, [T.StructField(text_col, T.StringType())], make, text_col).select(*[f"`{c}`" for c in docs.columns])


def digests(scanned: DataFrame) -> DataFrame:
    s = F.col("secret_spans")
    return scanned.select(
        "doc_id",
        *[S.count(s, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(S.joined(s, KINDS[:3]), 256).alias("base_sha256"),
        S.joined(s).alias("spans"),
        S.count(s, "literal").alias("n_literal"),
        "secret_score",
    )
