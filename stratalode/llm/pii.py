"""Personal data: patterns, and terms that disclose a protected entity by co-occurrence.

The base patterns find e-mail addresses, IP addresses, card and phone numbers, and
``name`` finds persons by a form of address or a field's label before them.
Each normalised value is a protected entity *e* with information content
``IC(e) = -log p(e)``.  A term *t* (a word of letters) near *e* on its line
discloses it by ``PMI(t, e) / IC(e) = 1 + log p(e | t) / -log p(e)``, estimated
from the whole corpus: occurrences of t outside entities, of e, and of both.  Terms
whose ratio exceeds ``generalise_at`` are found wherever they stand, as spans
of kind ``term``; redaction puts the broader class of words of their form in their
place (a name, an acronym, a word), and removes those above ``remove_at``.

A pair's contexts are those of independent documents: exact and near copies
(``COPY_K``-word shingles at similarity 0.8) are folded, and a group of copies
counts the differing contexts of the one that has most.  So copies of a line do
not make its words disclosing, and a line that stands alike in independent
documents does.  A pair with fewer than ``support`` contexts is rated as if the
missing ones had the term without the entity; one context proves nothing.

Flow: (1) one scan emits (entity, term, document) rows, summed where they are
made and again after the shuffle; (2) one scan counts words, summed in the same
way; (3) the documents of the pairs that may still be disclosing are grouped by
near copies; (4) the scan that returns the rows.  Up to ``BROADCAST_TERMS`` terms
are broadcast to a scan.  With more, (2) counts all words, and before (4) each
text's distinct words are joined to the terms, so the number of scans is fixed.

Defined results: null and empty texts have no spans; repeated rows repeat, and
count as often as they stand; with no entity, or an empty table, no term is
found; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalode.llm import near_dup
from stratalode.llm import spans as S
from stratalode.llm.runtime import hot_keys, join_hot, map_text, materialize, steps, strings, to_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "term", "gone")  # "gone" only while sanitising: a term to remove
#: Words on each side of an entity that count as its context.
WINDOW = 6
#: Fewest independent contexts of a pair, and words a shingle where documents are compared as copies.
LEAST, COPY_K = 2, 3
#: Terms that may be broadcast, and distinct words after which a task sends on its sums.
BROADCAST_TERMS, WORDS_HELD = 200_000, 200_000
#: Pairs or documents that may be broadcast to pick rows; with more, a shuffle join does it.
BROADCAST_ROWS = 1_000_000
TERM = re.compile(r"[^\W\d_]{3,}")
LABEL = {k: f"[{k.upper()}]" for k in (*BASE, "name")}
# Forms of address, and labels of fields that hold a person's name.
ADDRESS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr", "Sra")
FIELD = ("name", "full name", "first name", "last name", "surname", "patient", "nombre", "apellido", "nom", "vorname", "nachname")
CAPITALISED = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*+"
PERSON = rf"\x20?({CAPITALISED}(?:\x20{CAPITALISED}){{0,3}}+)"
ADDRESSED = re.compile(rf"\b(?:{'|'.join(ADDRESS)})\b\.?{PERSON}")
FIELDED = re.compile(rf"\b(?i:{'|'.join(FIELD)})[\"']?\x20?[:=]\x20?[\"']?{PERSON}")


def names(text: str) -> list[tuple[int, int]]:
    """Places of persons' names after a form of address or a field's label; words are searched before patterns, which is faster."""
    out = set()
    if any(k in text for k in ADDRESS):
        out |= {m.span(1) for m in ADDRESSED.finditer(text)}
    if (":" in text or "=" in text) and any(k in low for low in (text.lower(),) for k in FIELD):
        out |= {m.span(1) for m in FIELDED.finditer(text)}
    return sorted(out)


def personal(text: str) -> list[S.Span]:
    """The base spans, and the names that do not overlap one."""
    spans = S.personal(text)
    return spans + [("name", a, b) for a, b in names(text) if not _inside(a, b, spans)]


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip', 'name') else ''.join(c for c in value if '0' <= c <= '9')}"


def contexts(text: str, spans: list[S.Span]):
    """(entity hash, terms) of each base span: the words around it on its line, WINDOW on each side, without other entities."""
    for kind, a, b in spans:
        terms = {*_words_before(text, a, spans), *_words_after(text, b, spans)}
        yield xxhash.xxh64_intdigest(entity(kind, text[a:b])) - 2**63, terms


def _inside(a: int, b: int, spans: list[S.Span]) -> bool:
    return any(x < b and a < y for _, x, y in spans)


def _words_inside(text: str, spans: list[S.Span]) -> list[str]:
    """The words that overlap a span, each once."""
    found = {}
    for _, a, b in spans:
        while a and text[a - 1].isalpha():
            a -= 1
        while b < len(text) and text[b].isalpha():
            b += 1
        found |= {m.start(): m.group().lower() for m in TERM.finditer(text, a, b)}
    return list(found.values())


def _words_after(text: str, b: int, spans: list[S.Span]) -> list[str]:
    end = text.find("\n", b)
    out: list[str] = []
    for m in TERM.finditer(text, b, len(text) if end < 0 else end):
        if not _inside(*m.span(), spans):
            out.append(m.group().lower())
            if len(out) == WINDOW:
                break
    return out


def _words_before(text: str, a: int, spans: list[S.Span]) -> list[str]:
    start = text.rfind("\n", 0, a) + 1
    out: list[str] = []
    width, found = 256, []
    while True:  # widen until enough words stand whole in the part looked at
        low = max(start, a - width)
        found = [m for m in TERM.finditer(text, low, a) if not _inside(*m.span(), spans) and (low == start or m.start() > low)]
        if low == start or len(found) >= WINDOW:
            break
        width *= 4
    for m in found[-WINDOW:]:
        out.append(m.group().lower())
    return out


PAIRS = T.StructType([T.StructField("entity", T.LongType()), T.StructField("term", T.StringType()), T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("contexts", T.LongType())])
WORDS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("term", T.StringType())])
COUNTS = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])


def _pair_rows(batches):
    """A document's occurrences and differing contexts of each pair; summed over the batch, a null term counts the entity itself, a null entity the term inside entities."""
    for batch in batches:
        sums: Counter = Counter()
        seen: dict[tuple, set[int]] = {}
        for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            spans = personal(text)
            for t in _words_inside(text, spans):
                sums[None, t, 0] += 1
            for who, terms in contexts(text, spans):
                sums[who, None, 0] += 1
                for t in terms:
                    sums[who, t, doc] += 1
                    seen.setdefault((who, t, doc), set()).add(xxhash.xxh64_intdigest(" ".join(sorted(terms - {t}))))
        who, terms, docs = zip(*sums, strict=True) if sums else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(terms, pa.string()), pa.array(docs, pa.int64()), pa.array(list(sums.values()), pa.int64()), pa.array([len(seen.get(k, ())) for k in sums], pa.int64())], names=PAIRS.names)


def _count_rows(terms):
    """Sums of a task, of the known terms or of all words; a null term counts all."""

    def out(sums: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=COUNTS.names)

    def run(batches):
        known = None if terms is None else terms.value
        sums: Counter = Counter()
        for batch in batches:
            texts = strings(batch.column(0))
            for i, j in steps(texts):
                for text in texts[i:j]:
                    found = TERM.findall(text.lower())
                    sums[None] += len(found)
                    sums.update(found if known is None else [w for w in found if w in known])
                if len(sums) > WORDS_HELD and known is None:
                    yield out(sums)
                    sums = Counter()
        yield out(sums)

    return run


def _distinct_words(batches):
    """(doc, term) of each text's distinct words."""
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            found = list(set(TERM.findall(text.lower())))
            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(found, pa.string())], names=WORDS.names)


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _independent(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(entity, term, contexts) from ``members`` (entity, term, doc, contexts), with exact and near copies among the documents folded."""
    wanted = materialize(members.select("doc").distinct(), "pii-wanted")
    rows = texts.join(_few(wanted), "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text"))
    rows = materialize(rows.withColumnRenamed("doc", "doc_id"), "pii-copies")
    groups = near_dup.similar(rows, COPY_K).select(F.col("doc_id").alias("doc"), F.col("component_id").alias("copies"))
    found = members.join(groups, "doc").groupBy("entity", "term", "copies").agg(F.max("contexts").alias("contexts"))
    return found.groupBy("entity", "term").agg(F.sum("contexts").alias("contexts")).filter(F.col("contexts") >= LEAST)


def disclosing_terms(docs: DataFrame, text_col: str = "text", support: int = 3, generalise_at: float = 0.9) -> DataFrame:
    """(term, ratio): the terms whose disclosure of some entity reaches ``generalise_at``, from the whole corpus."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], "term string, ratio double")
    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("doc"), "text")
    sums = texts.mapInArrow(_pair_rows, PAIRS).groupBy("entity", "term", "doc").agg(F.sum("n").alias("n"), F.max("contexts").alias("contexts"))
    sums = materialize(sums, "pii-sums")
    # With copies counted apart a pair has as many contexts at least, so none is lost here.
    pairs = sums.filter("term IS NOT NULL AND entity IS NOT NULL").groupBy("entity", "term").agg(F.sum("n").alias("n"), F.sum("contexts").alias("most"))
    pairs = materialize(pairs.filter(F.col("most") >= LEAST), "pii-pairs")
    terms = materialize(pairs.select("term").distinct(), "pii-candidates")
    n = terms.count()
    if not n:
        return none
    shared = spark.sparkContext.broadcast(frozenset(r.term for r in terms.collect())) if n <= BROADCAST_TERMS else None
    counted = materialize(texts.select("text").mapInArrow(_count_rows(shared), COUNTS).groupBy("term").agg(F.sum("n").alias("total")), "pii-counts")
    words = counted.filter("term IS NULL").agg(F.sum("total")).first()[0]
    counts = counted.filter("term IS NOT NULL")
    inside = sums.filter("entity IS NULL").select("term", F.col("n").alias("inside"))
    counts = counts.join(inside, "term", "left").select("term", (F.col("total") - F.coalesce("inside", F.lit(0))).alias("total"))
    entities = sums.filter("term IS NULL").select("entity", F.col("n").alias("entity_n"))

    def ratio(contexts):
        share = F.least(F.lit(1.0), F.col("n") / F.greatest("n", "total")) * F.least(F.lit(1.0), F.col(contexts) / F.lit(float(support)))
        return 1 + F.log(share) / F.greatest(F.lit(1e-9), -F.log(F.col("entity_n") / F.lit(float(max(words or 0, 2)))))

    able = materialize(pairs.join(counts, "term").join(entities, "entity").filter(ratio("most") >= generalise_at), "pii-able")
    if able.isEmpty():
        return none
    members = sums.select("entity", "term", "doc", "contexts").join(_few(able.select("entity", "term")), ["entity", "term"], "left_semi")
    rated = able.join(_independent(texts, materialize(members, "pii-members")), ["entity", "term"]).select("term", ratio("contexts").alias("ratio"))
    return materialize(rated.groupBy("term").agg(F.max("ratio").alias("ratio")).filter(F.col("ratio") >= generalise_at), "pii-terms")


def _spans(text: str, known: dict[str, bool]) -> list[dict]:
    """The spans of a text with those of the known terms; a term that is True there is one to remove."""
    spans = personal(text)
    if known:
        low = [(known.get(m.group().lower()), m.span()) for m in TERM.finditer(text)]
        spans += [("gone" if strong else "term", *at) for strong, at in low if strong is not None and not _inside(*at, spans)]
    return S.rows(S.ordered(spans, KINDS))


def _mark(docs: DataFrame, terms: DataFrame, text_col: str, spans_col: str, remove_at: float | None = None) -> DataFrame:
    """All columns of ``docs`` and ``spans_col``; terms from ``remove_at`` on have the kind "gone"."""
    spark = docs.sparkSession
    terms = terms.select("term", (F.col("ratio") >= F.lit(remove_at) if remove_at is not None else F.lit(False)).alias("strong"))
    n = terms.count()
    if n <= BROADCAST_TERMS:
        shared = spark.sparkContext.broadcast({r.term: r.strong for r in terms.collect()})

        def make():
            known = shared.value
            return lambda texts: [[_spans(x, known) for x in texts]]

        return map_text(docs, [T.StructField(spans_col, S.SPANS)], make, text_col)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    docs = docs.withColumn("__doc", F.xxhash64(text))
    found = docs.select("__doc", text.alias("text")).mapInArrow(_distinct_words, WORDS).join(terms, "term").groupBy(F.col("doc").alias("__doc"))
    # A text has at most its own distinct words here.
    found = materialize(found.agg(F.map_from_entries(F.collect_set(F.struct("term", "strong"))).alias("__terms"), F.count("*").alias("size")), "pii-found")
    joined = join_hot(docs, found.select("__doc", "__terms"), "__doc", hot_keys(docs.groupBy("__doc").agg(F.count("*").alias("size")), "__doc", docs.count()), "left")
    names = [c for c in docs.columns if c not in (spans_col, "__doc")]
    source = joined.select(*[f"`{c}`" for c in names], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"), "__terms")

    def run(batches):
        for batch in batches:
            known = [dict(x or ()) for x in batch.column(len(names) + 1).to_pylist()]
            spans = [_spans(x, k) for x, k in zip(strings(batch.column(len(names))), known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(spans, to_arrow(S.SPANS))], names=[*names, spans_col])

    return source.mapInArrow(run, T.StructType([*[joined.schema[c] for c in names], T.StructField(spans_col, S.SPANS)]))


def scan(docs: DataFrame, text_col: str = "text", support: int = 3, generalise_at: float = 0.9, terms: DataFrame | None = None, spans_col: str = "pii_spans") -> DataFrame:
    """All columns of ``docs`` and ``spans_col``: the base spans, names, and disclosing terms."""
    return _mark(docs, disclosing_terms(docs, text_col, support, generalise_at) if terms is None else terms, text_col, spans_col)


def broader(word: str) -> str:
    """The class of all words of this form."""
    return "[ACRONYM]" if word.isupper() and len(word) < 6 else "[NAME]" if word[:1].isupper() else "[WORD]"


def cut(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its class, and without terms to remove; overlapping spans go as one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], "" if kind == "gone" else broader(text[a:b]) if kind == "term" else LABEL[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text", support: int = 3, generalise_at: float = 0.9, remove_at: float = 0.97) -> DataFrame:
    """``docs`` with personal data masked, disclosing terms generalised, and the strongest of these removed."""
    scanned = _mark(docs, disclosing_terms(docs, text_col, support, generalise_at), text_col, "__pii", remove_at)
    names = docs.columns
    at = names.index(text_col)
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields])

    def run(batches):
        for batch in batches:
            texts = strings(batch.column(at).cast(pa.string()))
            spans = batch.column(len(names)).to_pylist()
            made = [cut(x, [(s["kind"], s["start"], s["end"]) for s in found]) if found else x for x, found in zip(texts, spans, strict=True)]
            columns = [pa.array(made, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return scanned.select(*[f"`{n}`" for n in names], "__pii").mapInArrow(run, schema)


def digests(scanned: DataFrame, spans_col: str = "pii_spans") -> DataFrame:
    s = F.col(spans_col)
    return scanned.select(
        "doc_id",
        *[S.count(s, k).alias(f"n_{k}") for k in BASE],
        F.sha2(S.joined(s, BASE), 256).alias("base_sha256"),
        S.joined(s).alias("spans"),
        S.count(s, "name").alias("n_name"),
        S.count(s, "term").alias("n_term"),
    )
