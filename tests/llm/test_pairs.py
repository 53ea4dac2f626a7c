"""Operators 1 and 8 and the pipeline against brute force."""

import random
import re
from itertools import combinations

import pytest

from stratalode.llm import decontamination, near_dup
from stratalode.llm.components import components


def sellers(pattern, text):
    """Least edits from the pattern to a stretch of the text that ends at each place."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row


def test_myers_by_brute_force():
    rng = random.Random(3)
    for _ in range(800):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randrange(*r))) for r in ((1, 20), (0, 40)))
        assert decontamination.myers(decontamination.masks(p), len(p), t) == sellers(p, t)[1:]


def test_op1_by_brute_force(spark, words, odd, none):
    rng = random.Random(4)
    items = [(i, words(14)) for i in range(12)] + [(50, None), (51, ""), (52, "zu kurz"), (None, "ohne id"), (53, "; -")]
    docs = []
    for i in range(60):
        _, t = items[rng.randrange(12)]
        edited = list(t)
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(edited))
            rng.choice([lambda: edited.__setitem__(at, "q"), lambda: edited.pop(at), lambda: edited.insert(at, "z")])()
        docs.append((i, words(10) + ". " + ("".join(edited).upper() if i % 2 else "".join(edited)) + ", " + words(10)))
    docs += [(90, None), (91, ""), (92, words(40)), (93, "Das ist ZU, kurz!"), (94, "zu kurzer zu  kurz"), (95, "dazu kurz"), (96, "x\u0130 " * 30 + items[3][1]), (97, "Ohne ID steht hier"), (98, "\u0130 zu kurz")]
    rows = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for d, t in docs:
        for i, s in items[:12]:
            s, n = decontamination.normalise(s), decontamination.normalise(t or "")
            least, budget = min(sellers(s, n)), int(len(s) * decontamination.RATE)
            if least <= budget:
                want.add((d, i, least, budget))
    want |= {(93, 52, 0, 0), (94, 52, 0, 0), (98, 52, 0, 0), (97, None, 0, 0)}
    assert {(r.doc_id, r.item_id, r.distance, r.budget) for r in rows} == want and len(rows) == len(want)
    texts = dict(docs)
    for r in rows:
        if not r.distance:
            assert decontamination.normalise(texts[r.doc_id][r.start : r.end]) == decontamination.normalise(dict(items)[r.item_id])
    table = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in decontamination.decontaminate(table, items).collect()} == set(texts) - {d for d, *_ in want}
    assert decontamination.leaks(odd, items).count() == 0 and decontamination.decontaminate(odd, items).count() == odd.count()
    assert decontamination.leaks(none, items).count() == 0 and decontamination.leaks(odd, items.filter("false")).count() == 0


def plain_components(docs, k):
    """(n_shingles, least id reachable) of each row, by comparing all pairs of sets."""
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, (_, x)), (b, (_, y)) in combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[top(a)] = top(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[top(n)] = min(i, least.get(top(n), i))
    return sorted((str(i), len(s), str(None if i is None else least[top(n)] if s else i)) for n, (i, s) in enumerate(sets))


def near_copies(words, seed=8):
    rng = random.Random(seed)
    docs = []
    for g in range(12):
        base = words(rng.choice([3, 8, 40, 120])).split()
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 20) + 1)):
                w[rng.randrange(len(w))] = rng.choice(["changed", "Words", "HERE"])
            docs.append((len(docs) * 3, (" " if g % 2 else "\n").join(w)))
    return docs + [(1000, None), (1001, ""), (1002, " \t"), (1003, "A b"), (1004, "a  B"), (1005, "a b c")]


@pytest.mark.parametrize("k", [4, 5])
def test_op8_by_brute_force(spark, words, k):
    docs = near_copies(words)
    rows = near_dup.similar(spark.createDataFrame(docs, "doc_id long, text string"), k).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == plain_components(docs, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op8_large_nodes_are_dealt_into_blocks(spark, words, monkeypatch):
    """Nodes of over two classes branch, and those that stay large are dealt: the result is the same."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "LEVELS", 2)
    docs = near_copies(words, 9)
    rows = near_dup.similar(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == plain_components(docs, 4)


@pytest.mark.parametrize("star", [False, True])
def test_op8_contracts_large_groups(spark, words, monkeypatch, star):
    """A group of near copies that are alike, and one whose copies are like their original only, among other texts."""
    for name, value in (("SMALL", 16), ("REPS", 4), ("LEVELS", 2)):
        monkeypatch.setattr(near_dup, name, value)
    rng = random.Random(12)
    base = words(120).split()
    docs = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        if star:  # each in a stretch of its own: about 0.85 like the original, 0.73 like each other
            at = rng.randrange(0, 100)
            w[at : at + 7] = words(7).split()
        else:
            w[rng.randrange(120)] = "changed"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, words(100)) for i in range(40)] + [(200 + i, t) for i, (_, t) in enumerate(near_copies(words, 10))]
    rows = near_dup.similar(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == plain_components(docs, 4)


def test_op8_keeps_one_row_of_each_group(spark, words):
    """Rows without id link others, and rows are told apart by id and text together."""
    a, b, c = words(60), words(60), words(60)
    near = a.replace(a.split()[30], "changed", 1)
    docs = [(None, a), (None, near), (5, b), (5, a), (9, b), (9, b), (None, c), (None, c), (3, ""), (3, ""), (4, None)]
    table = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, root long")
    rows = near_dup.similar(table, 4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == plain_components(docs, 4)
    left = sorted((str(r.doc_id), r.text or "") for r in near_dup.drop_similar(table, 4).collect())
    # Of a and its near copy the row with an id, of b the least id, of c one row; texts without words all stay.
    assert left == sorted([("5", a), ("5", b), ("None", c), ("3", ""), ("3", ""), ("4", "")])


def test_op8_odd_rows(odd, none):
    rows = near_dup.similar(odd, 4).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[7].component_id == 6 and by_id[None].component_id is None and by_id[None].kept and by_id[2].component_id == 2
    assert near_dup.similar(none, 4).count() == 0
    left = near_dup.drop_similar(odd, 4)
    assert left.columns == odd.columns and left.filter("doc_id = 7").count() == 0 and left.filter("doc_id IS NULL").count() == 1
    assert left.filter("doc_id = 3").count() == 1  # of the repeated row one


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(40)] + [(500, i) for i in range(501, 530)] + [(None, 3), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert got == {x: top(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_keep_clean_documents(spark, words, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    docs, labels = [], []
    for i in range(160):
        t = words(60)
        if i % 5 == 0:
            t = " ".join(w + rng.choice(["***", "$$$"]) for w in t.split())
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, int(i % 5 != 0), 0))
    item = words(20)
    docs += [(200, docs[1][1], "en", "s", 1), (201, words(30) + " " + item + " " + words(30), "en", "s", 1), (202, words(60) + " mail ann@x.org now", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    assert ids == {i for i in range(160) if i % 5} | {202}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "pii", "bpe"]
    one = corpus_pipeline.sanitise(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).filter("doc_id = 202").first()
    assert "[EMAIL]" in one.text and "ann@x.org" not in one.text
