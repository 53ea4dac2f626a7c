"""Quality classifier: averaged subword embeddings with a softmax, trained by stochastic gradient descent.

A document's features are its words, the character 3- to 5-grams of each word
between ``<`` and ``>``, its word 2- and 3-grams, and its end mark, all hashed into
one table of learned vectors.  A word n-gram counts twice: as its words, and with
each word replaced by its first place in the n-gram, so that "a a b" and "c c d"
share the vector of "1 1 3" and repetition can be learned from other words.  The
document vector is the mean of its feature vectors, each occurrence counting
once, and two softmax outputs give the score.  As the output is linear in that
mean, scoring needs one number a feature, and a word's sum is computed once for
each task.

The fit uses a bounded sample of labelled rows: at most ``SAMPLE_ROWS`` texts and
``SAMPLE_BYTES`` bytes, the same number of each class where there are as many,
in the order of a hash of the id.  Rows for which ``crc32(id) % 5 == 0`` are held
out.  Scoring reads every row and the whole of its text.

Defined results: null and empty texts have only the end mark, and so a score;
repeated rows repeat; an id labelled twice has its highest label; without
labels of both classes every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalode.llm.runtime import WORD, map_text

SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 14_000_000
BUCKETS, DIM, RATE = 1 << 18, 16, 0.6
#: Steps of the descent: so many passes over a small sample, and as many at least over any.
STEPS, PASSES = 18_000, 5
CUT = 0.3
REMEMBERED = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)
FINDALL = re.compile(WORD).findall
END = 0  # bucket of the end mark
PLACES = 1 << 40  # added to the codes of n-grams of places, so that they hash as no word n-gram does


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat buckets of the words' features, how many each word has, and each word's hash."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lens = np.array([len(w) for w in words], dtype=np.int64) + 2
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lens)
    ends = np.cumsum(lens)
    left = ends[owner] - np.arange(len(chars))  # characters from here to the word's end
    found, owners = [], []
    h = chars
    for n in range(2, 6):
        h = h[:-1] * MIX + chars[n - 1 :]
        if n > 2:
            at = np.flatnonzero(left[: len(h)] >= n)
            found.append(_mix(h[at] + np.uint64(n)))
            owners.append(owner[at])
    inside = np.arange(1, len(chars) + 1, dtype=np.uint64) - np.repeat((ends - lens).astype(np.uint64), lens)
    whole = np.add.reduceat(_mix(chars * np.uint64(0x100000001B3) + inside), ends - lens)
    found.append(_mix(whole + np.uint64(99)))
    owners.append(np.arange(len(words)))
    buckets, owners_ = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners_, kind="stable")
    return _bucket(buckets[order]), np.bincount(owners_, minlength=len(words)), _mix(whole)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def gram_features(ids: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word 2- and 3-grams of words in order, and the owner of each; n-grams stay within one owner."""
    h, found, owners = hashes[ids], [], []
    for n in (2, 3):
        m = max(0, len(ids) - n + 1)
        at = np.flatnonzero(owner[:m] == owner[n - 1 :]) if m else np.zeros(0, np.int64)
        gram, places = np.full(len(at), n, dtype=np.uint64), np.full(len(at), PLACES * n, dtype=np.uint64)
        for k in range(n):
            first = np.full(len(at), k)
            for j in range(k - 1, -1, -1):
                first[ids[at + j] == ids[at + k]] = j
            gram = _mix(gram * MIX + h[at + k])
            places = places * np.uint64(n + 1) + first.astype(np.uint64)
        found += [_bucket(gram), _bucket(_mix(places))]
        owners += [owner[at]] * 2
    return np.concatenate(found), np.concatenate(owners)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts."""
    words = FINDALL(text)
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter((names[w] for w in words), dtype=np.int64, count=len(words))
    flat, lens, hashes = word_features(list(names))
    grams, _ = gram_features(ids, hashes, np.zeros(len(ids), np.int64))
    buckets = np.r_[flat, grams, END]
    weights = np.r_[np.repeat(np.bincount(ids, minlength=len(names)), lens), np.ones(len(grams) + 1)]
    at, where = np.unique(buckets, return_inverse=True)
    return at.astype(np.int32), np.bincount(where, weights=weights)


def fit(texts: list[str], labels: list[int], epochs: int | None = None, rate: float = RATE, seed: int = 1) -> np.ndarray:
    """One score a bucket: the learned vectors times the difference of the two output rows."""
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), dtype=np.float32)
    docs = [document_features(x) for x in texts]
    docs = [(at, (n / n.sum()).astype(np.float32)) for at, n in docs]
    epochs = epochs or max(PASSES, -(-STEPS // len(docs)))
    total, step = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)).tolist():
            at, share = docs[k]
            rows = table[at]
            mean = share @ rows
            z = out @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            now = rate * (1 - step / total)
            back = p @ out
            out -= now * p[:, None] * mean
            table[at] = rows - (now * share)[:, None] * back
            step += 1
    return (table @ (out[1] - out[0])).astype(np.float64)


class Scorer:
    """Scores texts with the sums of the words seen; at most about ``remembered`` words."""

    def __init__(self, weights: np.ndarray, remembered: int = REMEMBERED):
        self.weights, self.remembered = weights, remembered
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def score(self, texts: list[str]) -> np.ndarray:
        found = [FINDALL(x) for x in texts]
        flat = [w for ws in found for w in ws]
        if len(self.index) > self.remembered:
            self.clear()
        if new := list(set(flat).difference(self.index)):
            buckets, lens, hashes = word_features(new)
            sums = np.add.reduceat(self.weights[buckets], np.cumsum(lens) - lens)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.sums, self.counts, self.hashes = np.r_[self.sums, sums], np.r_[self.counts, lens], np.r_[self.hashes, hashes]
        ids = np.fromiter(map(self.index.__getitem__, flat), dtype=np.int64, count=len(flat))
        owner = np.repeat(np.arange(len(found)), [len(ws) for ws in found])
        grams, owners = gram_features(ids, self.hashes, owner)
        total = lambda at, values=None: np.bincount(at, weights=values, minlength=len(found))
        sums = total(owner, self.sums[ids]) + total(owners, self.weights[grams]) + self.weights[END]
        counts = total(owner, self.counts[ids]) + total(owners) + 1
        return 1 / (1 + np.exp(-sums / counts))


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: labelled rows that are not held out, within the bounds."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max(label_col) > 0).cast("int").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    ids = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy("place", "doc_id").limit(rows // 2)
        ids = part if ids is None else ids.unionByName(part)
    # Both tables broadcast here have at most `rows` rows.
    lengths = docs.select("doc_id", F.octet_length(text).alias("bytes")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label", "place").agg(F.max("bytes").alias("bytes"))
    taken, used = [], 0
    for r in sorted(lengths.collect(), key=lambda r: (r.place, r.doc_id)):
        if used + r.bytes <= size:
            taken.append((r.doc_id, r.label))
            used += r.bytes
    chosen = spark.createDataFrame(taken, "doc_id long, label int")
    pairs = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")).collect()
    pairs.sort(key=lambda r: r.doc_id)
    return [r.text for r in pairs], [r.label for r in pairs]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> np.ndarray:
    return fit(*sample(docs, labels, label_col, rows, size))


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers, 2 MB

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [scorer.score(texts)]

    return map_text(docs, [T.StructField(score_col, T.DoubleType())], make, text_col)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    scored = score(docs, train(docs, labels), score_col="__score")
    return scored.filter(F.col("__score") >= CUT).select(*[f"`{c}`" for c in docs.columns])
