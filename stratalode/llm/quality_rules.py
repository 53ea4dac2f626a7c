"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once; the ledger keeps its measurements and one failure
bit per rule.  A policy is a named, versioned set of rules, so applying one, or
comparing many, is bit arithmetic on the stored ledger, and ablations are one
bitwise aggregation: no text is read again.

Lines and windows of five words are compared by 64-bit hashes, within one text.

Defined results: null and empty texts have no words, so all measurements are 0
and they fail ``few_words``; repeated rows repeat; texts of any length are
measured whole; columns of ``docs`` beside the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalode.llm.runtime import id_text, materialize

SPACES = r"[\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

#: (name, failing condition over the measurements), in the order of their bits; whole numbers only.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("exclamations", "100 * n_exclamations > 30 * n_words"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Rules of each policy by (name, version).
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("standard", 1): tuple(BIT),
    ("lenient", 1): ("few_words", "repeated_windows", "symbols"),
}


def mask(policy: tuple[str, int]) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of each whole text."""
    d = id_text(docs, id_col, text_col)
    # Words are hashed where the text is split, so that later steps hold numbers only.
    words = F.transform(F.split(F.btrim("text", F.lit(SPACE)), SPACES), lambda word: F.xxhash64(word))
    d = d.select(
        "doc_id",
        F.char_length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        F.when(F.btrim("text", F.lit(SPACE)) != "", words).otherwise(F.array().cast("array<bigint>")).alias("words"),
        F.transform(F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), lambda line: F.xxhash64(line)).alias("lines"),
        F.regexp_replace("text", r"[^#*$%&|<>!A-Z]+", "").alias("marks"),
    )
    hashes = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        *[F.char_length(F.translate("marks", gone, "")).cast("long").alias(name) for name, gone in (("n_symbols", "!" + CAPITALS), ("n_exclamations", SYMBOLS + CAPITALS), ("n_capitals", "!" + SYMBOLS))],
        F.when(F.size("words") >= WINDOW, hashes).alias("windows"),
    )
    d = d.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    # Only texts with a repeated window sort their windows; equal ones are then neighbours.
    d = d.withColumn("windows", F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get("windows", k)
    same = lambda k, other: F.coalesce(at(k)["h"] == at(other)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    places = F.transform(twice, lambda k: at(k)["i"])
    d = d.withColumn("places", F.when(F.col("repeats"), F.sort_array(places)))
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size("places") - 1),
        F.lit(WINDOW).cast("long"),
        lambda total, k: total + F.least(F.lit(WINDOW), F.get("places", k) - F.get("places", k - 1)),
    )
    repeated = F.when(F.coalesce(F.col("repeats"), F.lit(False)), covered).otherwise(F.lit(0).cast("long"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_exclamations", "n_capitals", repeated.alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``failure_bits``, one bit for each of RULES."""
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits + F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
    return measure(docs, id_col, text_col).withColumn("failure_bits", bits)


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a table in the shared folder, from which verdicts, policies and ablations come without another look at the texts."""
    return materialize(ledger(docs, id_col, text_col), "quality-ledger")


def fails(policy: tuple[str, int]) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def apply_policies(found: DataFrame, policies: list[tuple[str, int]] | None = None) -> DataFrame:
    """The ledger and one boolean ``kept_<name>_v<version>`` for each policy."""
    return found.withColumns({f"kept_{name}_v{version}": ~fails((name, version)) for name, version in policies or list(POLICIES)})


def ablations(found: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects (kept without it).

    One aggregation over the ledger, of a few numbers a task.
    """
    bits = F.col("failure_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    counts = []
    for r in POLICIES[policy]:
        counts += [F.sum((bits.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).cast("long")).alias(f"f_{r}"), F.sum((bits == BIT[r]).cast("long")).alias(f"o_{r}")]
    one = found.agg(F.count("*").alias("n"), F.bit_and(bits).alias("always"), *counts)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(f"f_{r}"), F.lit(0)).alias("failed"), F.coalesce(F.col(f"o_{r}"), F.lit(0)).alias("only_this"), (F.coalesce(F.col("always"), F.lit(0)).bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).alias("all_fail"))
        for r in POLICIES[policy]
    ])).alias("x")).select("x.*")


def verdicts(docs: DataFrame, policy: tuple[str, int] = ("standard", 1), found: DataFrame | None = None) -> DataFrame:
    """The base measurements, base_failed, kept (also by ``lenient``) and the failure bits of each row, from the stored ledger."""
    found = stored_ledger(docs) if found is None else found
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails(("base", 1)).alias("base_failed"),
        (~fails(("base", 1)) & ~fails(policy)).alias("kept"),
        (~fails(("lenient", 1))).alias("kept_lenient"),
        "failure_bits",
    )


def sql(policy: tuple[str, int] = ("standard", 1)) -> str:
    bits = " + ".join(f"CASE WHEN {fails} THEN {BIT[name]} ELSE 0 END" for name, fails in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c >= 2),
c AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclamations,
             length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, ({bits})::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failure_bits & {mask(("base", 1))}) <> 0 AS base_failed,
       (failure_bits & {mask(("base", 1)) | mask(policy)}) = 0 AS kept, (failure_bits & {mask(("lenient", 1))}) = 0 AS kept_lenient, failure_bits
FROM b"""
