"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary and one smoothing; a
document's score is the difference of its mean loss a token, target minus
background, so a low score is close to the target.

All words and all bigrams of the corpus are in the models, V distinct words and
one that was never seen:

    p(w | h) = (c(h, w) + MU * p(w)) / (c(h) + MU),  p(w) = (c(w) + 1) / (N + V + 1)

A document that a model was counted from is scored without its own counts, so
that target documents gain nothing from being in it.

Flow: (1) one scan writes the texts as groups of about ``GROUP_TOKENS`` tokens;
(2) a group sends each bucket of keys its own sums of the words and bigrams
there; a bucket adds the sums of all groups and answers each group with the
totals of its keys, in their order; (3) a group scores its texts with the answers.  A key is one entry a group, so a frequent one is no larger
than others; no count is broadcast, and the driver gets a few sums.  Groups have
a fixed size and buckets grow in number with the corpus, so what a task holds is
bounded.  Words and bigrams are known by 64-bit hashes.

Defined results: null and empty texts have 0 tokens and losses and score 0; an
empty target gives the smoothed uniform model; repeated rows count and are
scored as often as they stand; an id that is a target makes all its rows target.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalode.llm.runtime import materialize, small_batches, strings

MU = 50.0
#: Target ids that may be broadcast; with more, a shuffle join marks the rows.
BROADCAST_IDS = 1_000_000
#: Tokens and rows after which a group ends, tokens scored in one step, and characters of the corpus for each bucket.
GROUP_TOKENS, GROUP_ROWS, STEP_TOKENS, BUCKET_CHARS = 1_000_000, 65_536, 200_000, 8 << 20
LEAST_BUCKETS = 24
FINDALL = re.compile(r"\w+|[^\w\s]+").findall
#: Hash of the beginning of a text, and the odd factors that make a bigram's key of two hashes.
BEGIN, HEAD, WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
CODEC = pa.Codec("zstd", compression_level=1)

SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("target_loss", T.DoubleType()), T.StructField("background_loss", T.DoubleType()), T.StructField("score", T.DoubleType())])
SUMS = ("tokens", "target_tokens", "texts", "target_texts")
CELLS = T.StructType([T.StructField("group", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("data", T.BinaryType())])
#: A group's texts, with bucket -1 so that they come before the answers.
GROUPS = T.StructType([*CELLS.fields, *[T.StructField(n, T.LongType()) for n in SUMS]])
#: ``words`` is the number of distinct words of the bucket, in one of its rows.
ANSWERS = T.StructType([*CELLS.fields, T.StructField("words", T.LongType())])
GROUP_KINDS = (np.uint64, np.int32, np.int64, np.bool_, np.int64, np.bool_)  # hashes, ids, tokens a text, marks, doc ids, null ids
COUNT_KINDS = (np.uint64, np.int32, np.int32) * 2  # steps between sorted keys, counts, counts in the target: of words, of bigrams
ANSWER_KINDS = (np.int64,) * 4  # totals, totals in the target: of words, of bigrams


class Ids(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str) -> list[str]:
    return FINDALL(text.lower())


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays' lengths, and their bytes by place, which compress better so."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return np.array([len(a) for a in arrays], np.int64).tobytes() + CODEC.compress(b"".join(planes), asbytes=True)


def unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    n = np.frombuffer(data, np.int64, len(kinds)).tolist()
    widths = [np.dtype(kind).itemsize for kind in kinds]
    body = CODEC.decompress(data[8 * len(kinds) :], sum(k * w for k, w in zip(n, widths, strict=True)), asbytes=True)
    out, at = [], 0
    for k, w, kind in zip(n, widths, kinds, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, k * w, at).reshape(w, k).T).reshape(-1).view(kind))
        at += k * w
    return out


def marked(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, target): all rows, with a mark on those of the target."""
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("doc_id"), F.lit(True).alias("target")).filter("doc_id IS NOT NULL").distinct()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(ids, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``keys`` by bucket and key, and where each bucket starts in it; a bucket is a range of keys."""
    order = np.argsort(keys)
    at = ((keys[order] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return order, np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))


class Group:
    """Texts as ids of the group's own words; ``size - 1`` is the beginning of a text."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray, marks: np.ndarray):
        self.hashes, self.ids, self.n, self.marks = hashes, ids.astype(np.int64), n, marks
        self.size = len(hashes) + 1
        self.last = np.zeros(len(ids), dtype=bool)
        self.last[np.cumsum(n)[n > 0] - 1] = True
        self.before = np.r_[self.size - 1, np.where(self.last[:-1], self.size - 1, self.ids[:-1])] if len(ids) else self.ids
        both, count = np.unique((self.before * self.size + self.ids) << 1 | np.repeat(marks, n), return_counts=True)
        self.pairs, at = np.unique(both >> 1, return_index=True)
        self.pair_counts = [np.add.reduceat(x, at) if len(at) else x for x in (count, count * (both & 1))]
        self.word_counts = [np.bincount(x, minlength=len(hashes)) for x in (self.ids, self.ids[np.repeat(marks, n)])]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        known = np.r_[self.hashes, BEGIN]
        return self.hashes, known[self.pairs // self.size] * HEAD + known[self.pairs % self.size] * WORD

    def counts(self, buckets: int):
        """(bucket, packed keys and counts) of each bucket that has any."""
        cut = []
        for keys, counts in zip(self.keys(), (self.word_counts, self.pair_counts), strict=True):
            order, starts = dealt(keys, buckets)
            cut.append((keys[order], [c[order].astype(np.int32) for c in counts], starts.tolist()))
        for k in range(buckets):
            parts = []
            for keys, counts, starts in cut:
                at = slice(starts[k], starts[k + 1])
                parts += [np.diff(keys[at], prepend=np.uint64(0)), *[c[at] for c in counts]]
            if len(parts[0]) or len(parts[3]):
                yield k, pack(*parts)

    def losses(self, answers: list[list[np.ndarray]], buckets: int, model: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Mean loss in bits of each text under the target and the background model without itself."""
        totals = []
        for keys, at in zip(self.keys(), (0, 2), strict=True):
            order = dealt(keys, buckets)[0]
            table = np.zeros((2, len(keys)))
            for m, column in ((0, at + 1), (1, at)):
                table[m, order] = np.concatenate([a[column] for a in answers]) if answers else 0.0
            totals.append(table)
        out = np.zeros((2, len(self.n)))
        ends = np.r_[0, np.cumsum(self.n)]
        i = 0
        while i < len(self.n):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + STEP_TOKENS)))
            j = min(j, len(self.n))
            if ends[j] > ends[i]:
                out[:, i:j] = self._step(slice(ends[i], ends[j]), slice(i, j), *totals, model)
            i = j
        return out[0], out[1]

    def _step(self, at: slice, rows: slice, words: np.ndarray, pairs: np.ndarray, model: dict[str, int]) -> np.ndarray:
        size, begin, ids, n = self.size, self.size - 1, self.ids[at], self.n[rows]
        owner = np.repeat(np.arange(len(n)), n)
        # Distinct (text, bigram) with its count in the text, and the text's own counts of both words.
        both, own_pairs = np.unique((owner * size + self.before[at]) * size + ids, return_counts=True)
        text, pair = both // (size * size), both % (size * size)
        heads, tails = pair // size, pair % size
        known, own = np.unique(owner * size + ids, return_counts=True)
        last = self.last[at]
        as_head = own.copy()
        np.subtract.at(as_head, np.searchsorted(known, owner[last] * size + ids[last]), 1)  # a text's last word heads no bigram
        own_tails = own[np.searchsorted(known, text * size + tails)]
        own_heads = np.where(heads == begin, 1, as_head[np.minimum(np.searchsorted(known, text * size + heads), len(own) - 1)])
        found = np.searchsorted(self.pairs, pair)
        head_at = np.minimum(heads, begin - 1)
        out = np.zeros((2, len(n)))
        for m, mine in ((0, self.marks[rows][text]), (1, np.ones(len(text), dtype=bool))):
            total, texts = (model["target_tokens"], model["target_texts"]) if m == 0 else (model["tokens"], model["texts"])
            c = pairs[m][found] - own_pairs * mine
            unit = (words[m][tails] - own_tails * mine + 1) / (total - n[text] * mine + model["words"] + 1)
            head = np.where(heads == begin, texts, words[m][head_at]) - own_heads * mine
            out[m] = np.bincount(text, weights=-np.log2((c + MU * unit) / (head + MU)) * own_pairs, minlength=len(n)) / np.maximum(n, 1)
        return out


def _groups(most: int):
    def run(batches):
        made, index = TaskContext.get().partitionId() << 32, Ids()
        ids, n, marks, docs, size = [], [], [], [], 0

        def out():
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), np.uint64, len(index))
            lens, flags = np.array(n, np.int64), np.array(marks, bool)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            state = pack(hashes, flat, lens, flags, np.array([d or 0 for d in docs], np.int64), np.array([d is None for d in docs], bool))
            sums = [int(lens.sum()), int(lens[flags].sum()), int((lens > 0).sum()), int((lens[flags] > 0).sum())]
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([-1], pa.int32()), pa.array([state], pa.binary()), *[pa.array([s], pa.int64()) for s in sums]], names=GROUPS.names)

        for batch in batches:
            for doc, text, mark in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                found = tokens(text)
                ids.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
                n.append(len(found))
                marks.append(mark)
                docs.append(doc)
                size += len(found)
                if size >= most or len(n) >= GROUP_ROWS:
                    yield out()
                    made, size = made + 1, 0
                    for x in (index, ids, n, marks, docs):
                        x.clear()
        if n:
            yield out()

    return run


def _counts(buckets: int):
    def run(batches):
        for batch in batches:
            for group, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cells = list(Group(*unpack(data, GROUP_KINDS)[:4]).counts(buckets))
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(cells), pa.int64()), pa.array([k for k, _ in cells], pa.int32()), pa.array([x for _, x in cells], pa.binary())], names=CELLS.names)

    return run


def _series(batches, key: int):
    """(key, rows) of neighbours that have one key; a row is its columns' values."""
    held, now = [], None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def _answers(batches):
    """Totals of a bucket's keys for each group that has them, in the group's order."""
    for bucket, rows in _series(batches, 1):
        parts = [unpack(r[2], COUNT_KINDS) for r in rows]
        totals, words = [], 0
        for at in (0, 3):
            known, where = np.unique(np.concatenate([np.cumsum(p[at], dtype=np.uint64) for p in parts]), return_inverse=True)
            words = words or len(known) * (at == 0)
            cuts = np.cumsum([len(p[at]) for p in parts])[:-1]
            for column in (at + 1, at + 2):
                total = np.bincount(where, weights=np.concatenate([p[column] for p in parts]), minlength=len(known)).astype(np.int64)
                totals.append(np.split(total[where], cuts))
        data = [pack(*x) for x in zip(*totals, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(data, pa.binary()), pa.array([words, *[0] * (len(rows) - 1)], pa.int64())], names=ANSWERS.names)


def _scores(buckets: int, model: dict[str, int]):
    def run(batches):
        for _, rows in _series(batches, 0):
            hashes, ids, n, marks, docs, null = unpack(rows[0][2], GROUP_KINDS)
            a, b = Group(hashes, ids, n, marks).losses([unpack(r[2], ANSWER_KINDS) for r in rows[1:]], buckets, model)
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=null), pa.array(n), pa.array(a), pa.array(b), pa.array(a - b)], names=SCORES.names)

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Scores of all ``docs`` under models of the target's documents and of all documents."""
    small_batches(docs.sparkSession)
    rows = marked(docs, target_ids)
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, chars // BUCKET_CHARS)
    groups = materialize(rows.mapInArrow(_groups(group_tokens), GROUPS), "lm-groups")
    texts = groups.select(*CELLS.names)
    counts = texts.mapInArrow(_counts(buckets), CELLS).repartition("bucket").sortWithinPartitions("bucket")
    answers = materialize(counts.mapInArrow(_answers, ANSWERS), "lm-answers")
    model = groups.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in SUMS]).first().asDict()
    model["words"] = answers.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    both = texts.unionByName(answers.select(*CELLS.names))
    return both.repartition("group").sortWithinPartitions("group", "bucket").mapInArrow(_scores(buckets, model), SCORES)
