"""Operators 5, 6, 7 and 9."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from stratalode.llm import lm_scoring, quality_classifier, quality_rules, sharding


@pytest.fixture(scope="module")
def labelled(spark, words):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(240):
        t = words(rng.randrange(20, 80))
        if i % 4 == 0:
            t = " ".join(w + rng.choice(["***", "$$$", "###"]) for w in t.split())
        docs.append((i, t))
        labels.append((i, int(i % 4 != 0)))
    docs += [(900, None), (901, ""), (None, "no id")]
    labels += [(3, 0), (None, 1), (4, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_op5_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == 243 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 240]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) / len(held) >= 0.95
    kept = quality_classifier.keep(docs, labels)
    assert kept.columns == docs.columns


def test_op5_odd_tables(odd, none, labelled, spark):
    _, labels = labelled
    assert {r.score for r in quality_classifier.classify(odd, labels.filter("false")).collect()} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0
    assert quality_classifier.classify(odd, labels).count() == odd.count()


def test_op5_sample_is_bounded(labelled):
    docs, labels = labelled
    texts, marks = quality_classifier.sample(docs, labels, rows=20, size=10_000)
    assert len(texts) <= 20 and sum(map(len, texts)) <= 10_000 and set(marks) == {0, 1}


def test_op6_by_brute_force(spark, words, monkeypatch):
    docs = [(i, words(12) if i % 3 else "common words here " + words(5)) for i in range(60)] + [(80, None), (81, ""), (82, "unseen!! unseen!!")]
    target = {i for i in range(60) if i % 2 == 0}
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()}
    toks = {i: lm_scoring.tokens(t or "") for i, t in docs}

    def counts(ids):
        one, two = Counter(), Counter()
        for i in ids:
            one.update(toks[i])
            two.update(zip([None, *toks[i][:-1]], toks[i]))
        return one, two

    everyone = counts(toks)
    often = {k for k, n in everyone[1].items() if n > 1}
    vocabulary = len(everyone[0])
    for i in toks:
        n = len(toks[i])
        assert got[i].n_tokens == n
        if not n:
            assert got[i].score == 0
            continue
        loss = []
        for members in (target, set(toks)):
            one, two = counts(members)
            heads = sum(1 for j in members if toks[j])
            mine, own = (1, counts([i])) if i in members else (0, (Counter(), Counter()))
            total = 0
            for h, w in zip([None, *toks[i][:-1]], toks[i]):
                unit = (one[w] - own[0][w] + 1) / (sum(one.values()) - n * mine + vocabulary + 1)
                c = max(0, two[h, w] - own[1][h, w]) if (h, w) in often else 0
                own_head = (1 if h is None else own[0][h] - (toks[i][-1] == h)) * mine
                head = (heads if h is None else one[h]) - own_head
                total -= math.log2((c + lm_scoring.MU * unit) / (max(head, c, 0) + lm_scoring.MU))
            loss.append(total / n)
        assert abs(got[i].target_loss - loss[0]) < 1e-9 and abs(got[i].background_loss - loss[1]) < 1e-9


def test_op6_keeps_rare_words_and_bigrams(spark):
    # 20,000 words that stand three times each, of which no fixed vocabulary holds all; the rare pairs are the target's own.
    names = [f"w{i:05}" for i in range(20_000)]
    docs = [(i, " ".join(names[i % 100 :: 100])) for i in range(300)] + [(300, " ".join(names[7::100])), (301, " ".join(names[8::100][::-1]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(107,)], "doc_id long")
    members = {i for i in range(0, 300, 2)} | {107}
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(frame, target, group_tokens=1_500).collect()}
    assert len(got) == len(docs)
    toks = {i: t.split() for i, t in docs}
    for m, field in ((members, "target_loss"), (set(toks), "background_loss")):
        one, two = Counter(), Counter()
        for i in m:
            one.update(toks[i])
            two.update(zip([None, *toks[i][:-1]], toks[i]))
        for i in (7, 8, 107, 108, 203, 300, 301):
            mine, loss = int(i in m), 0
            for h, w in zip([None, *toks[i][:-1]], toks[i]):
                unit = (one[w] - mine + 1) / (sum(one.values()) - len(toks[i]) * mine + len(names) + 1)
                head = (len(m) if h is None else one[h]) - mine
                loss -= math.log2((two[h, w] - mine + lm_scoring.MU * unit) / (head + lm_scoring.MU))
            assert abs(got[i][field] - loss / len(toks[i])) < 1e-9, (i, field)


def test_op6_odd_tables(odd, none):
    ids = odd.select("doc_id").filter("doc_id < 4")
    assert lm_scoring.cross_entropy_difference(odd, ids).count() == odd.count()
    assert lm_scoring.cross_entropy_difference(odd, ids.filter("false")).count() == odd.count()
    assert lm_scoring.cross_entropy_difference(none, ids).count() == 0


def test_op7_rows(spark, odd, none, words):
    docs = odd.unionByName(spark.createDataFrame([(100 + i, words(1 + i % 50)) for i in range(400)], "doc_id long, text string"), allowMissingColumns=True)
    source = docs.collect()
    rows = sharding.shard(docs, 8).collect()
    assert len(rows) == len(source)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    largest = max(len((r.text or "").encode()) + 1 for r in source)
    rest = (sum(sizes.values()) - largest) / 7
    assert max(sizes.values()) <= largest + 1 and all(abs(n - rest) < 50 for n in sorted(sizes.values())[:-1])
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    group = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None
        group.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert all(len(s) == 1 for s in group.values())
    assert sorted((r["size"], r.text_crc32) for r in rows) == sorted((len(b := (r.text or "").encode()) + 1, zlib.crc32(b)) for r in source)
    assert sharding.shard(none, 8).count() == 0


def test_differencing_is_near_the_best():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randrange(1, 40) for _ in range(8)]
        best = min(max(sum(s for s, p in zip(sizes, part) if p == k) for k in range(3)) for part in product(range(3), repeat=8))
        found = [p[0] for p in sharding.differencing([[s] for s in sizes], 3)]
        assert max(sum(s for s, p in zip(sizes, found) if p == k) for k in range(3)) <= best * 1.25
    assert sharding.differencing([], 3) == [] and sharding.differencing([[5]], 3) == [[0]]
    sizes = np.array([rng.randrange(1, 10_000) for _ in range(5_000)])
    for chunk in (10_000, 300):  # at once, and in chunks whose partial partitions are joined
        totals = np.bincount(sharding.partition(sizes, 8, chunk), weights=sizes)
        assert max(totals) - min(totals) <= 8


def test_op7_by_brute_force(spark, odd, words, monkeypatch):
    """All rows, also with buckets, blocks and single groups of small size: sizes, checksums, equal texts together, balance, slots."""
    rng = random.Random(3)
    texts = [words(rng.randrange(1, 60)) for _ in range(300)] + ["same text"] * 60 + ["", None]
    docs = odd.select("doc_id", "text").filter("doc_id <> 5 OR doc_id IS NULL").unionByName(spark.createDataFrame([(i % 350, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    plain = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    for small in (False, True):
        if small:
            for name, value in (("BUCKET_GROUPS", 40), ("CHUNK", 7), ("BUCKET_ROWS", 50), ("BLOCK", 3)):
                monkeypatch.setattr(sharding, name, value)
        rows = sharding.shard(docs, 8, **({"bins": 64, "loose": 30} if small else {})).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == plain
        shard_of = {}
        for r in rows:
            assert shard_of.setdefault((r["size"], r.text_crc32), r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
        totals = [sum(r["size"] for r in rows if r.shard == k) for k in range(8)]
        assert max(totals) - min(totals) <= 8
        for k in range(8):
            slots = sorted(r.slot for r in rows if r.shard == k)
            assert slots == list(range(len(slots)))


def plain_measures(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_op9_measures_by_brute_force(spark, words, odd, none):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    texts += ["\n".join([words(6)] * 3 + [words(4)]) for _ in range(10)] + ["###$$$ é\x0b\x0cx\x85y\xa0z", "\n\n \n", words(400) + " " + words(20) * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.verdicts(docs).collect():
        n = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
    assert quality_rules.verdicts(odd).count() == odd.count() and quality_rules.verdicts(none).count() == 0
    assert {r.n_words for r in quality_rules.verdicts(odd).filter("doc_id IN (1, 2, 4)").collect()} == {0}


def test_op9_ledger_policies_and_ablations(spark, words):
    texts = [words(40), "a b", "*** " * 40, words(40).replace(" ", "!! "), (words(8) + "\n") * 6]
    found = quality_rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kept = {r.doc_id: (r.kept_base_v1, r.kept_standard_v1) for r in quality_rules.apply_policies(found).collect()}
    assert kept[0] == (True, True) and kept[3] == (True, False) and kept[1] == (False, False)
    policy = ("standard", 1)
    bits = [r.failure_bits for r in found.collect()]
    for r in quality_rules.ablations(found, policy).collect():
        bit = quality_rules.BIT[r.rule]
        assert r.failed == sum(bool(b & bit) for b in bits) and r.only_this == sum(b == bit for b in bits)
    assert quality_rules.ablations(found.filter(F.lit(False)), policy).count() == len(quality_rules.POLICIES[policy])
