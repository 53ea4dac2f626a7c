"""Connected components by alternating large and small stars, each step a table in the shared folder.

Up to ``ONE_TASK`` links are taken in one task instead, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalode.llm.runtime import discard, materialize

#: Links of 16 bytes that one task may hold.
ONE_TASK = 500_000


def _in_one_task(batches):
    held = list(batches)
    a, b = (np.concatenate([np.zeros(0, np.int64), *[np.asarray(x.column(c)) for x in held]]) for c in (0, 1))
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        # Hook the label of each end, then jump to labels of labels.
        for ends in (left, right):
            np.minimum.at(new, label[ends], low)
            np.minimum.at(new, ends, low)
        while (jump := new[new] != new).any():
            new[jump] = new[new][jump]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label] if len(nodes) else nodes)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (a, b); root is the least node reachable.

    Self-links and repeated links are allowed; null ends are ignored; without
    edges the result is empty.  The number of steps grows with the logarithm of
    the longest path, and each step moves each link a fixed number of times.
    The neighbourhoods' minima are a table, so that Spark can split the rows of
    a hub in the join with them.
    """
    links = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = materialize(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "links")
    if links.count() <= ONE_TASK:
        return links.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("size")), "links-least")
        # Stars: every node is the least of its neighbourhood or has one neighbour only.
        if not least.filter("m < a AND size > 1").limit(1).count():
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        # Large star: a node tells each larger neighbour the least of its neighbourhood.
        large = both.filter("b > a").join(least.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Small star: a node links its smaller neighbours and itself to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before = links
        links = materialize(small.filter("a <> b").distinct(), "links")
        discard(before, least)
