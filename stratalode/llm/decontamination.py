"""Benchmark decontamination by pigeonhole edit matching.

An item leaks into a document if some stretch of the document is within
``budget = floor(rate * length)`` edits of it, both normalised (lower case, one
space for each run of anything but letters and digits).  The item is split
into ``budget + 1`` pieces; ``budget`` edits leave one of them whole, so an
Aho-Corasick pass over the document for all pieces finds every place to look at.
There, Myers' bit-parallel algorithm gives the least edit distance.

Items under ``LEAST`` normalised characters are too short for edits to tell a leak
from chance, and match whole words exactly.

Documents are read once per block of items, and blocks hold about ``BLOCK_BYTES``
of item text, so what is broadcast is bounded however many items there are.

Defined results: null or empty documents, and items without a letter or digit,
match nothing; an item without id matches as any, with a null id; items with
equal texts each match; repeated rows repeat; a document of any length is
searched whole.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalode.llm.runtime import strings

RATE, LEAST = 0.05, 32
BLOCK_BYTES = 4_000_000
TOKEN = re.compile(r"[^\W_]+")

FOUND = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("distance", T.IntegerType()),
    T.StructField("budget", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])


def normalise(text: str) -> str:
    """The runs of letters and digits, in lower case, with one space between them."""
    return " ".join(TOKEN.findall(text)).lower()


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(pattern_masks: dict[str, int], length: int, text: str, anchored: bool = False) -> list[int]:
    """The distance of the pattern to the best stretch of ``text`` ending at each position.

    ``anchored`` stretches start where the text does.
    """
    full, high = (1 << length) - 1, 1 << length - 1
    plus, minus, score = full, 0, length
    out = []
    first = 1 if anchored else 0
    for c in text:
        eq = pattern_masks.get(c, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(d0 | plus) & full
        down = d0 & plus
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = up << 1 | first
        plus = (down << 1 | ~(d0 | up)) & full
        minus = up & d0 & full
        out.append(score)
    return out


class Item:
    def __init__(self, item_id: int | None, text: str, rate: float):
        self.id, self.text = item_id, text
        self.short = len(text) < LEAST
        self.budget = 0 if self.short else int(len(text) * rate)
        self.masks, self.back = masks(text), masks(text[::-1])

    def pieces(self):
        """(offset, piece): budget + 1 pieces of nearly equal length."""
        n = self.budget + 1
        cuts = [i * len(self.text) // n for i in range(n + 1)]
        for a, b in zip(cuts, cuts[1:]):
            yield a, self.text[a:b]

    def best(self, text: str, starts: list[int]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best stretch near the given starts, if within the budget."""
        k, n, found = self.budget, len(self.text), None
        starts = sorted(set(starts))
        if self.short:
            whole = (a for a in starts if (not a or text[a - 1] == " ") and text[a + n : a + n + 1] in ("", " "))
            return next(((0, a, a + n) for a in whole), None)
        i = 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= 2 * k:
                j += 1
            a, b = max(0, starts[i] - k), min(len(text), starts[j] + n + k)
            i = j + 1
            part = text[a:b]
            scores = myers(self.masks, n, part)
            least = min(scores, default=n)
            if least <= k and (found is None or least < found[0]):
                end = scores.index(least) + 1
                back = myers(self.back, n, part[:end][::-1][: n + k], anchored=True)
                found = (least, a + end - 1 - back.index(least), a + end)
                if not least:
                    break
        return found


class Matcher:
    """All items of a block and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.items = [Item(i, t, rate) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for offset, piece in item.pieces():
                pieces.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """The leaks in one text; start and end are code points of the text as it is, at whole words."""
        norm = normalise(text)
        if not self.items or not norm:
            return []
        starts: dict[int, list[int]] = {}
        for at, (length, owners) in self.automaton.iter(norm):
            for n, offset in owners:
                starts.setdefault(n, []).append(at - length + 1 - offset)
        out = []
        places = None
        for n, where in starts.items():
            item = self.items[n]
            if found := item.best(norm, where):
                places = places or self.places(text)
                distance, a, b = found
                words = [p for p in places if p[1] > a and p[0] < b]
                out.append({"item_id": item.id, "distance": distance, "budget": item.budget, "start": words[0][2], "end": words[-1][3]})
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["start"]))

    @staticmethod
    def places(text: str) -> list[tuple[int, int, int, int]]:
        """(start, end) of each word in the normalised text, and in the text."""
        out, at = [], 0
        for m in TOKEN.finditer(text):
            n = len(m.group().lower())
            out.append((at, at + n, *m.span()))
            at += n + 1
        return out


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The items in lists of about BLOCK_BYTES of text; a list is small enough to broadcast."""
    items = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        some = sorted(((r.item_id, normalise(r.text)) for r in some), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield [(i, t) for i, t in some if t]


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item that leaks into it: doc_id, item_id, distance, budget, start, end."""
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *FOUND.fields])
    out = None
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(strings(batch.column(1))):
                    found = matcher.find(text)
                    at += [i] * len(found)
                    rows += found
                columns = [pa.array([r[f.name] for r in rows], pa.int64() if f.name == "item_id" else pa.int32()) for f in FOUND.fields]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=schema.names)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks."""
    names = docs.columns
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                texts = strings(batch.column(names.index(text_col)).cast(pa.string()))
                yield batch.filter(pa.array([not matcher.find(x) for x in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
