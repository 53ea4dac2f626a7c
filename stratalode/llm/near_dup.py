"""Near-duplicates by a chosen-path set similarity join.

1. Every text becomes the set of its word shingles and ``WIDTH`` minwise tokens.
   Texts with equal sets form a class, and only classes go on, so copies cost
   nothing more, however many they are.
2. Chosen paths: the root of each of ``TREES`` trees, and every node with over
   ``SMALL`` classes, selects one or two tokens (1.25 in the mean, the inverse of
   the similarity 0.8) by its own hash, and a class goes to one child for each
   selected token, named by its value.  A pair at the threshold meets in one
   child in the mean, so it stays together with a chance that falls slowly with
   depth: about 0.84, 0.73 and 0.64 after one to three levels.  Twelve
   trees miss it with a chance of about 5e-6 at depth three.
3. Small nodes are compared exhaustively: first by tokens (a pair at the
   threshold agrees on 37 of 64 but with a chance of 2e-5), each pair only in the
   least node that both are in; then the classes with such a pair are compared
   on their full sets.  Pairs are not emitted: a node gives a spanning forest of
   its links.
4. Large nodes are contracted, at the first level where a sample of the node's
   classes is alike and at the last always: their rows are dealt into blocks, each
   with the node's ``REPS`` most central classes as well, and links found there
   join classes to parts.  Work grows in proportion to the node, and the sample
   decides only when it is done.  A node of one part is done.  One in which all
   but ``SMALL / 2`` classes are one part is finished in blocks of that part, with
   the few others as guests in each.  Only what is left branches; after ``LEVELS``
   levels each two blocks of it are compared, so nothing is capped.
5. Components of the links, by large and small stars.

The trees come in two rounds.  The links of the first ``FIRST`` trees give
parts, and in the other trees only pairs of different parts count that no node had before.

Skew: hot minwise tokens make large nodes, which are contracted and branch on; a
hot class is one row, and the join back to its rows leaves these where they are.
What a task holds is a node or block: about ``SMALL`` sets with ``MASS`` shingles.

Defined results: null and empty texts have an empty set and are linked with
nothing; a row without id keeps its row, with a null component, and links others
as any row; repeated ids and rows repeat, each with the component of its set; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalode.llm.components import components
from stratalode.llm.runtime import discard, hot_keys, id_text, join_hot, materialize, runs, small_batches, steps, strings
from stratalode.llm.shingles import minwise, mix, set_digests, shingle_sets

WIDTH, TREES, FIRST, LEVELS = 64, 12, 2, 4
#: Most classes of a small node, and most shingles of all its classes.
SMALL, MASS = 1024, 8_000_000
#: Central classes of a large node that are in each of its blocks.
REPS = 64
#: Mean share of tokens in common, in millionths, of the most central class of a sample, from which a node is alike.
ALIKE = 50_000
#: Tokens that a pair must share to be compared in full.
AGREE = 37
#: Rows of a few numbers that may be broadcast in a join; with more, a shuffle join does it.
BROADCAST_ROWS = 500_000

LONG = T.LongType()
ROWS = T.StructType([T.StructField("doc_id", LONG), T.StructField("row_key", LONG), T.StructField("n_shingles", LONG), T.StructField("cid", LONG), T.StructField("digest", LONG), T.StructField("tokens", T.BinaryType())])
#: A class in a node of a tree, and the part that it belongs to so far.
PLACE = T.StructType([T.StructField("node", LONG), T.StructField("cid", LONG), T.StructField("n_shingles", LONG), T.StructField("part", LONG)])
LIKELY = T.StructType([T.StructField("block", LONG), T.StructField("cid", LONG), T.StructField("part", LONG)])
CENTRAL = T.StructType([T.StructField("node", LONG), T.StructField("cid", LONG), T.StructField("score", LONG)])
LINKS = T.StructType([T.StructField("a", LONG), T.StructField("b", LONG)])
SETS = T.StructType([T.StructField("cid", LONG), T.StructField("shingles", T.BinaryType())])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = strings(batch.column(batch.num_columns - 1))
    for i, j in steps(texts):
        yield i, j, [t.encode("utf-8", "surrogatepass") for t in texts[i:j]]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and text: the key tells rows apart that differ in id or text, also those without id."""
    return id_text(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")


def describe(docs: DataFrame, k: int) -> DataFrame:
    """ROWS of whole texts: set size, class (two digests) and minwise tokens; null class for empty sets."""

    def run(batches):
        for batch in batches:
            for i, j, texts in _texts(batch):
                sets = shingle_sets(texts, k)
                first, second = set_digests(sets)
                tokens = minwise(sets, WIDTH)
                empty = np.array([len(s) == 0 for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        batch.column(1).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(first.view(np.int64), pa.int64(), mask=empty),
                        pa.array(second.view(np.int64), pa.int64(), mask=empty),
                        pa.array([None if e else t.tobytes() for e, t in zip(empty, tokens, strict=True)], pa.binary()),
                    ],
                    names=ROWS.names,
                )

    return keyed(docs).mapInArrow(run, ROWS)


def children(nodes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Child nodes of (node, class) rows and the rows they come from; the node alone selects the tokens."""
    h = mix(nodes)
    first = (h % np.uint64(WIDTH)).astype(np.int64)
    second = ((h >> np.uint64(20)) % np.uint64(WIDTH)).astype(np.int64)
    two = np.flatnonzero(((h >> np.uint64(40)) % np.uint64(4) == 0) & (first != second))
    rows = np.r_[np.arange(len(nodes)), two]
    token = np.r_[first, second[two]]
    return mix(h[rows] ^ mix(tokens[rows, token].astype(np.uint64) << np.uint64(8) | token.astype(np.uint64))), rows


def _branch(trees: range):
    """Children, as PLACE rows, of the rows (node or null for all roots, cid, n_shingles, part, tokens)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint32).reshape(-1, WIDTH)
            if batch.column(0).null_count:
                roots = mix(np.arange(trees.start + 1, trees.stop + 1, dtype=np.uint64))
                parts = [children(np.full(len(tokens), r), tokens) for r in roots]
                nodes, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            else:
                nodes, rows = children(np.asarray(batch.column(0)).view(np.uint64), tokens)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), *[pa.array(np.asarray(batch.column(c))[rows]) for c in (1, 2, 3)]], names=PLACE.names)

    return run


def _sized(rows: DataFrame, level: int) -> DataFrame:
    """PLACE rows of the nodes with two parts or more, and ``blocks``, the small nodes that each would fill."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("mass"), F.min("part").alias("low"), F.max("part").alias("high"))
    blocks = F.greatest(F.ceil(F.col("size") / SMALL), F.ceil(F.col("mass") / MASS)).cast("int").alias("blocks")
    # A table, so that Spark can split the rows of a hot node in the join.
    sizes = materialize(sizes.filter("low <> high").select("node", "size", blocks), f"near-sizes{level}")
    return materialize(rows.join(sizes, "node"), f"near-sized{level}")


def _own(blocks) -> F.Column:
    return F.pmod(F.xxhash64("cid", "node"), blocks).cast("int")


#: How a class is in the blocks of its node: in one, in all but its own as a guest, or in each pair of blocks with its own.
ONE, GUEST, PAIRS = 0, 1, 2


def _places(rows: DataFrame, kind: int, block=None, own=None) -> DataFrame:
    """Rows to compare: class, part, and place (the node, and how the class is in its blocks)."""
    block = F.lit(0).cast("long") if block is None else block
    blocks = F.col("blocks") if kind else F.lit(0)
    own = F.lit(-1) if own is None else own
    return rows.select("cid", "part", F.struct(F.col("node").alias("home"), F.lit(kind).alias("kind"), block.alias("block"), blocks.alias("blocks"), own.alias("own")).alias("place"))


def _blocks(place) -> F.Column:
    """(block, side) of a place; two rows of one side other than 0 are not compared."""
    row = lambda block, side: F.struct(block.alias("block"), side.alias("side"))
    all_of = F.sequence(F.lit(0), place["blocks"] - 1)
    guest = F.transform(F.filter(all_of, lambda o: o != place["own"]), lambda o: row(F.xxhash64(place["home"], o), F.lit(1)))
    side = lambda o: F.when(place["own"] == o, 0).when(place["own"] < o, 1).otherwise(2)
    pairs = F.transform(all_of, lambda o: row(F.xxhash64(place["home"], F.least(o, place["own"]), F.greatest(o, place["own"])), side(o)))
    return F.when(place["kind"] == ONE, F.array(row(place["block"], F.lit(0)))).when(place["kind"] == GUEST, guest).otherwise(pairs)


class Join:
    """The links of classes, and the parts that they join."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int):
        self.docs, self.k = docs, k
        self.classes = classes
        self.short = classes.select("cid", "n_shingles", _low_bytes(F.col("tokens")).alias("tokens"))
        self.parts: DataFrame | None = None
        #: The nodes in which a class was compared with all classes of other parts.
        self.homes: DataFrame | None = None
        self.sets: list[DataFrame] = []

    def parted(self, rows: DataFrame) -> DataFrame:
        """PLACE rows with the parts as they are now."""
        if self.parts is None:
            return rows
        names = rows.columns
        found = rows.withColumnRenamed("part", "before").join(_few(self.parts).select(F.col("node").alias("before"), "root"), "before", "left")
        return found.withColumn("part", F.coalesce("root", "before")).select(*names)

    def tree_rows(self, trees: range) -> None:
        """Run the trees: contract, compare, branch; ``parts`` has their links at the end."""
        start = self.classes.select(F.lit(None).cast("long").alias("node"), "cid", "n_shingles", F.col("cid").alias("part"), "tokens")
        rows = self.parted(start).mapInArrow(_branch(trees), PLACE)
        found = []
        for level in range(1, LEVELS + 1):
            rows = materialize(rows, f"near-level{level}")
            sized = _sized(rows, level)
            discard(rows)
            found.append(_places(sized.filter("blocks = 1"), ONE, F.col("node")))
            left = sized.filter("blocks > 1")
            if left.isEmpty():
                break
            if level in (1, LEVELS):
                if self.parts is not None:
                    left = self.finish(left, found)
                if (self.parts is None or level == LEVELS) and self.contract(left, level == LEVELS):
                    left = self.finish(_sized(self.parted(left.select(*PLACE.names)), level), found)
                if left.isEmpty():
                    break
            if level < LEVELS:
                rows = self.classes.select("cid", "tokens").join(_few(left), "cid").select("node", "cid", "n_shingles", "part", "tokens").mapInArrow(_branch(trees), PLACE)
            else:
                # Still many parts: each two blocks of about half a small node are compared.
                dealt = left.withColumn("blocks", 2 * F.col("blocks"))
                found.append(_places(dealt, PAIRS, own=_own(F.col("blocks"))))
        places = found[0]
        for f in found[1:]:
            places = places.unionByName(f)
        self.add(self.compare(places, once=True))

    def contract(self, large: DataFrame, full: bool) -> bool:
        """Join classes of large nodes to parts: blocks compared in themselves and with the node's most central classes.

        All nodes and all their classes are looked at if ``full``; else a sample of
        each node, and only nodes with a sample that is alike are contracted.
        """
        blocks = F.greatest(F.ceil(F.col("blocks") * SMALL / max(1, SMALL - REPS)), F.lit(2)).cast("int")
        dealt = large.withColumn("blocks", blocks).withColumn("own", _own(F.col("blocks")))
        looked = dealt.withColumn("block", F.xxhash64("node", "own")) if full else dealt.filter(F.pmod(F.xxhash64("cid", "node", F.lit("sample")), F.col("size")) < SMALL // 2).withColumn("block", F.col("node"))
        best = _by_block(looked.join(self.short, "cid").select("block", "node", "cid", "tokens")).mapInArrow(_central(0 if full else ALIKE), CENTRAL)
        if full:
            # One for each of REPS hash slots: the number is fixed, and no node's rows are ranked in one task.
            best = best.groupBy("node", F.pmod(F.xxhash64("cid"), F.lit(REPS)).alias("slot")).agg(F.max(F.struct("score", "cid")).alias("best")).select("node", F.col("best.cid").alias("cid"))
        reps = materialize(best.select("node", "cid"), "near-reps")
        if reps.isEmpty():
            return False
        if not full:
            dealt = dealt.join(reps.select("node").distinct(), "node", "left_semi")
        guests = dealt.join(reps, ["node", "cid"], "left_semi")
        places = _places(dealt, ONE, F.xxhash64("node", "own")).unionByName(_places(guests, GUEST, own=F.col("own")))
        self.add(self.compare(places, once=False))
        return True

    def finish(self, sized: DataFrame, found: list[DataFrame]) -> DataFrame:
        """Add the places of the nodes that can be compared now; the rows of the others."""
        counts = sized.groupBy("node", "part").agg(F.count("*").alias("n"))
        most = counts.groupBy("node").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("all"))
        few = F.col("all") - F.col("most.n") <= SMALL // 2
        most = most.select("node", F.col("most.part").alias("main"), few.alias("few"))
        rows = materialize(sized.join(_few(materialize(most, "near-most")), "node"), "near-left")
        mixed = rows.filter("few").withColumn("blocks", 2 * F.col("blocks"))
        others = mixed.filter("part <> main")
        found.append(_places(mixed.filter("part = main"), ONE, F.xxhash64("node", _own(F.col("blocks")))))
        found.append(_places(others, GUEST))
        found.append(_places(others, ONE, F.xxhash64("node", F.lit(-1))))
        return rows.filter("NOT few").drop("main", "few")

    def compare(self, places: DataFrame, once: bool) -> DataFrame:
        """LINKS between classes of different parts with similarity 0.8 or more: a spanning forest of them in each block.

        With ``once``, a pair is compared only in the least node that both classes are in, and not if one of the
        first trees had both in a node.
        """
        # A few places a class and tree: how many blocks a guest is in shows only after the join.
        rows = places.groupBy("cid").agg(F.first("part").alias("part"), F.collect_list("place").alias("places"))
        none = F.array().cast("array<long>")
        rows = rows.withColumn("shared", F.array_distinct("places.home") if once else none).withColumn("before", none)
        if once:
            rows = materialize(rows, "near-places")
            if self.homes is not None:
                rows = rows.drop("before").join(self.homes, "cid", "left").withColumn("before", F.coalesce("before", none))
            else:
                self.homes = rows.select("cid", F.col("shared").alias("before"))
        if self.parts is not None:
            parts = _few(self.parts).select(F.col("node").alias("cid"), "root")
            rows = rows.join(parts, "cid", "left").withColumn("part", F.coalesce("root", "part")).drop("root")
        rows = rows.join(self.short, "cid")
        rows = rows.select("cid", "part", "n_shingles", "tokens", "shared", "before", F.explode("places").alias("place"))
        rows = rows.select("cid", "part", "n_shingles", "tokens", "shared", "before", F.col("place.home").alias("home"), F.explode(_blocks(F.col("place"))).alias("at"))
        rows = rows.select("at.block", "home", "at.side", "cid", "part", "n_shingles", "tokens", "shared", "before")
        likely = materialize(_by_block(rows).mapInArrow(_likely(once), LIKELY), "near-likely")
        self.fetch(likely.select("cid").distinct())
        sets = None
        for s in self.sets:
            sets = s if sets is None else sets.unionByName(s)
        links = materialize(_by_block(sets.join(_few(likely), "cid").select("block", "part", "shingles")).mapInArrow(_verify, LINKS), "near-links")
        discard(likely)
        return links

    def fetch(self, wanted: DataFrame) -> None:
        """Store the sets of the classes in ``wanted`` (cid) that are not stored yet."""
        wanted = self.classes.select("cid", "rep_key").join(_few(materialize(wanted, "near-named")), "cid")
        for s in self.sets:
            wanted = wanted.join(s.select("cid"), "cid", "left_anti")
        self.sets.append(materialize(class_sets(self.docs, materialize(wanted, "near-wanted"), self.k), "near-sets"))

    def add(self, links: DataFrame) -> None:
        """The parts with links between them added."""
        found = materialize(components(links), "near-joined")
        if self.parts is not None:
            moved = self.parts.withColumnRenamed("root", "old").join(_few(found).select(F.col("node").alias("old"), "root"), "old", "left")
            new = found.join(self.parts.select("node"), "node", "left_anti").select("node", "root")
            found = materialize(moved.select("node", F.coalesce("root", "old").alias("root")).unionByName(new), "near-parts")
        self.parts = found


def _nodes(batches, columns: int) -> Iterator[list]:
    """Whole nodes from rows sorted by node: one list of column arrays for each run of batches, cut at node ends."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        nodes = np.asarray(held.column(0))
        if not len(nodes) or nodes[0] == nodes[-1]:
            continue
        last = int(np.searchsorted(nodes, nodes[-1])) if nodes[0] <= nodes[-1] else 0
        yield [held.column(c).slice(0, last) for c in range(columns)]
        held = held.slice(last)
    if held is not None and held.num_rows:
        yield [held.column(c) for c in range(columns)]


def _agreement(group: np.ndarray, i: int) -> np.ndarray:
    """Tokens that row i of each group shares with the rows after it."""
    return (group[:, i + 1 :] == group[:, i : i + 1]).sum(axis=2, dtype=np.int16)


def _bits(tokens: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(tokens.to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)


def _central(least: int):
    """(node, cid, score) of the REPS classes of each block that share the most tokens with the others, in blocks where the best has ``least``."""

    def run(batches):
        for block, node, cid, tokens in _nodes(batches, 4):
            bits, taken = _bits(tokens), [np.zeros(0, np.int64)]
            scores = np.zeros(len(bits), dtype=np.int64)
            for a, b in runs(np.asarray(block)):
                for x in range(WIDTH):
                    _, at, n = np.unique(bits[a:b, x], return_inverse=True, return_counts=True)
                    scores[a:b] += n[at]
                # In proportion, so that blocks of unlike sizes compare.
                scores[a:b] = scores[a:b] * 1_000_000 // ((b - a) * WIDTH)
                order = a + np.argsort(-scores[a:b], kind="stable")[:REPS]
                if scores[order[0]] >= least:
                    taken.append(order)
            at = pa.array(np.concatenate(taken))
            yield pa.RecordBatch.from_arrays([node.take(at), cid.take(at), pa.array(scores).take(at)], names=CENTRAL.names)

    return run


def _likely(once: bool):
    """LIKELY rows of the classes that have in a block, with ``once`` in the least node of both, a pair which may be similar."""

    def run(batches):
        for block, home, side, cid, part, size, tokens, shared, before in _nodes(batches, 9):
            blocks, homes, sides, sizes, parts = (np.asarray(x) for x in (block, home, side, size, part))
            bits = _bits(tokens)
            by_size: dict[int, list[int]] = {}
            for a, b in runs(blocks):
                by_size.setdefault(b - a, []).append(a)
            marked = np.zeros(len(blocks), dtype=bool)
            lists: dict[int, tuple[set, set]] = {}

            def in_nodes(i: int) -> tuple[set, set]:
                if i not in lists:
                    lists[i] = set(shared[i].as_py()), set(before[i].as_py())
                return lists[i]

            def is_first(p: int, q: int) -> bool:
                (a, earlier_a), (b, earlier_b) = in_nodes(p), in_nodes(q)
                return min(a & b) == homes[p] and not earlier_a & earlier_b

            for m, starts in by_size.items():
                if m < 2:
                    continue
                for x in range(0, len(starts), step := max(1, 4_000_000 // (m * m * WIDTH))):
                    at = np.array(starts[x : x + step])
                    rows = at[:, None] + np.arange(m)
                    group, n, own, of = bits[rows], sizes[rows], parts[rows], sides[rows]
                    for i in range(m - 1):  # class i against all after it, in all blocks of this size
                        low, high = np.minimum(n[:, i + 1 :], n[:, i : i + 1]), np.maximum(n[:, i + 1 :], n[:, i : i + 1])
                        able = (100 * low >= 80 * high) & (own[:, i + 1 :] != own[:, i : i + 1]) & ((of[:, i : i + 1] == 0) | (of[:, i + 1 :] != of[:, i : i + 1]))
                        if not able.any():
                            continue
                        likely = able & (_agreement(group, i) >= AGREE)
                        g, j = np.nonzero(likely & ~(marked[rows[:, i : i + 1]] & marked[rows[:, i + 1 :]]))
                        for p, q in zip(rows[g, i].tolist(), rows[g, i + 1 + j].tolist(), strict=True):
                            if not (marked[p] and marked[q]) and (not once or is_first(p, q)):
                                marked[p] = marked[q] = True
            yield pa.RecordBatch.from_arrays([pa.array(blocks[marked]), pa.array(np.asarray(cid)[marked]), pa.array(parts[marked])], names=LIKELY.names)

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, exactly, from the shingles that two or more share."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    out = np.zeros((m, m))
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        width = max(1, 4_000_000 // m)
        for x in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [x, x + width])
            part = np.zeros((m, min(width, int(column[-1]) + 1 - x)), dtype=np.float32)
            part[owner[a:b], column[a:b] - x] = 1
            out += part @ part.T  # counts below 2**24, exact in float32
    return out


def _verify(batches):
    """Links between the parts of each block's classes by their full sets, as a spanning forest."""
    for block, part, shingles in _nodes(batches, 3):
        parts = part.to_pylist()
        left, right = [], []
        for a, b in runs(np.asarray(block)):
            sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in shingles[a:b]]
            sizes = np.array([len(s) for s in sets])
            common = intersections(sets)
            linked = 100 * common >= 80 * (sizes[:, None] + sizes[None, :] - common)
            first: dict[int, int] = {}
            root = [first.setdefault(p, i) for i, p in enumerate(parts[a:b])]

            def top(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
                if (p := top(int(i))) != (q := top(int(j))):
                    root[p] = q
                    left.append(parts[a + i])
                    right.append(parts[a + j])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=LINKS.names)


def _by_block(rows: DataFrame) -> DataFrame:
    """Rows of a block together and in order, in many partitions."""
    return rows.repartition("block").sortWithinPartitions("block")


def class_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """SETS of the classes in ``wanted`` (cid, rep_key), from the text of one row of each."""
    reps = _few(wanted).select(F.col("rep_key").alias("row_key"), F.col("cid").alias("want"))
    rows = keyed(docs).join(reps, "row_key").select("want", "text")

    def run(batches):
        seen: set[int] = set()  # rows equal in id and text: one a task
        for batch in batches:
            new = [not (c in seen or seen.add(c)) for c in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            for i, j, texts in _texts(batch):
                sets = shingle_sets(texts, k)
                same = set_digests(sets)[0].view(np.int64) == np.asarray(batch.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).filter(pa.array(same)), pa.array([s.tobytes() for s, y in zip(sets, same, strict=True) if y], pa.binary())], names=SETS.names)

    return rows.mapInArrow(run, SETS)


def _low_bytes(tokens):
    """The first byte of each four: enough of a token to estimate similarity."""
    return F.unhex(F.regexp_replace(F.hex(tokens), "(..)......", "$1"))


def members(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """ROWS, and (cid, root) of the classes that are linked to others; the root names their component."""
    small_batches(docs.sparkSession)
    rows = materialize(describe(docs, k), "near-rows")
    # Two classes of one cid, the first digest, would merely be taken as one.
    classes = rows.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("row_key").alias("rep_key"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))
    join = Join(docs, materialize(classes, "near-classes"), k)
    join.tree_rows(range(FIRST))
    join.tree_rows(range(FIRST, TREES))
    return rows, join.parts.select(F.col("node").alias("cid"), "root")


def similar(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; k words a shingle, similarity 0.8 or more."""
    rows, roots = members(docs, k)
    classes = rows.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = classes.join(roots, "cid", "left").filter("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "cid"))
    named = materialize(named, "near-named")
    # A hot root's classes stay where they are: its least id is one row.
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("size")), "near-least")
    total = rows.count()
    component = join_hot(named.select("root", "cid", "copies"), least.select("root", "component"), "root", hot_keys(least, "root", total))
    component = materialize(component.select("cid", "component", F.col("copies").alias("size")), "near-component")
    out = join_hot(rows.select("doc_id", "n_shingles", "cid"), component.select("cid", "component"), "cid", hot_keys(component, "cid", total), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_similar(docs: DataFrame, k: int = 5) -> DataFrame:
    """``docs`` with one row of each component, that of the least id (rows without id last) and row key."""
    rows, roots = members(docs, k)
    # One entry for each text and id; what is left of equal rows is one of them.
    keys = rows.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("cid").alias("cid"), F.count("*").alias("n"))
    keys = keys.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    keys = materialize(keys, "near-keys")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = keys.filter("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("size"))
    first = materialize(first.select("root", F.col("first.row_key").alias("first_key"), "size").filter("size > 1"), "near-first")
    joined = join_hot(keys.filter("root IS NOT NULL"), first.select("root", "first_key"), "root", hot_keys(first, "root", keys.count()))
    gone = materialize(joined.filter("row_key <> first_key").select(F.col("row_key").alias("__key")), "near-gone")
    names = [f"`{c}`" for c in docs.columns]
    left = docs.withColumn("__key", F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))))  # as in keyed
    left = left.join(_few(gone), "__key", "left_anti")
    repeated = materialize(keys.filter("n > 1 AND cid IS NOT NULL").select(F.col("row_key").alias("__key")), "near-repeated")
    if repeated.isEmpty():
        return left.select(*names)
    once = left.join(_few(repeated), "__key", "left_semi").groupBy("__key").agg(F.first(F.struct(*names)).alias("__row")).select("__row.*")
    return left.join(_few(repeated), "__key", "left_anti").select(*names).unionByName(once)


def _few(rows: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint, if it was counted to be small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
