"""Sharding by Karmarkar-Karp differencing, with equal texts kept together.

Groups (equal texts) are indivisible, and every group goes through the
differencing.  It works on partial partitions, one sum a shard: it takes the two
of largest spread and joins them oppositely ordered, the largest sum of one with
the smallest of the other, until one partition is left.  As partial partitions
can be joined in any order, the work is dealt out:

1. A group of more than ``total / BINS`` bytes is a partial partition of its own;
   there are fewer than ``BINS`` of these.  So are about ``LOOSE`` other groups,
   chosen by hash, which even out at the end what the others leave.
2. The rest is dealt by hash into at most ``BINS`` buckets.  A bucket's
   task sorts them, differences ``CHUNK`` at a time, and joins the chunks to one
   partial partition by differencing.
3. The driver joins what is left, about ``2 * BINS + LOOSE`` partial partitions at
   most at any size of input, in the same way.

So with up to ``LOOSE`` groups this is the differencing of all of them; with more,
the largest spreads meet first within a chunk, a bucket and at the end.  Texts never move, a group's rows are summed where they
are read before the shuffle, and the rows of a hot group stay where they are.

Slots: rows fall into numbering buckets by a hash of their row number, so equal
rows spread too; a bucket numbers its rows, and the rows before a bucket are
summed over blocks of buckets, then over blocks.

Defined results: a null text has 0 bytes, so size 1, and goes with the empty
texts; ties between equal spreads fall by the order of items (hash order), so
results repeat; an empty table gives an empty result; a row without id is placed
as any row.  A group larger than a fair share gets a shard almost to itself,
which is the best there is for indivisible groups.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalode.llm.runtime import hot_keys, join_hot, materialize, small_batches

#: Most buckets of small groups, and the bound on the number of large ones.
BINS = 4_096
#: Other groups that the driver differences one by one, about.
LOOSE = 16_384
#: Groups differenced at once, and groups of a bucket, about (more where there are over BINS times as many).
CHUNK, BUCKET_GROUPS = 20_000, 100_000
#: Rows of a numbering bucket, about, and buckets of a block.
BUCKET_ROWS, BLOCK = 100_000, 1_024

PARTS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("group", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("bytes", T.LongType())])


def differencing(partials: list[list[int]], shards: int) -> list[list[int]]:
    """The shard of each part of each partial partition (lists of at most ``shards`` sums; a part of sum 0 is in none)."""
    # In the heap: negative spread, order, and the parts by falling sum, each with the tree of what is in it.
    heap = []
    for n, sums in enumerate(partials):
        parts = [(x, (n, i)) if x else (0, None) for i, x in enumerate(sums)] + [(0, None)] * (shards - len(sums))
        parts.sort(key=lambda p: -p[0])
        heap.append((parts[-1][0] - parts[0][0], n, parts))
    heapq.heapify(heap)
    order = len(partials)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = [(x + y, [s, t] if s and t else s or t) for (x, s), (y, t) in zip(a, reversed(b), strict=True)]
        joined.sort(key=lambda p: -p[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], order, joined))
        order += 1
    found = [[0] * len(sums) for sums in partials]
    for shard, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [tree] if tree else []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                found[x[0]][x[1]] = shard
            else:
                stack += x
    return found


def partition(sizes: np.ndarray, shards: int, chunk: int = CHUNK) -> np.ndarray:
    """The part of each size: chunks of falling sizes, and the chunks' partial partitions, by differencing."""
    order = np.argsort(-sizes, kind="stable")
    parts = np.zeros(len(sizes), dtype=np.int32)
    starts = range(0, len(sizes), chunk)
    sums = []
    for x in starts:
        at = order[x : x + chunk]
        parts[at] = [p[0] for p in differencing([[s] for s in sizes[at].tolist()], shards)]
        sums.append([int(sizes[at][parts[at] == p].sum()) for p in range(shards)])
    for x, names in zip(starts, differencing(sums, shards), strict=True):
        at = order[x : x + chunk]
        parts[at] = np.array(names, dtype=np.int32)[parts[at]]
    return parts


def _parts(shards: int):
    """PARTS rows of whole buckets, from rows (bucket, group, bytes) sorted by bucket."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            bucket, group, size = (table.column(c).to_numpy() for c in range(3))
            cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)] if len(bucket) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a:b]), pa.array(group[a:b]), pa.array(partition(size[a:b], shards)), pa.array(size[a:b])], names=PARTS.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and held[-1].column(0)[-1] != batch.column(0)[0]:
                yield from out()
                held = []
            held.append(batch)
        if held:
            yield from out()

    return run


def assign(groups: DataFrame, shards: int, bins: int = BINS, loose: int = LOOSE) -> DataFrame:
    """(group, shard) of the groups (group, bytes, n): a stored table."""
    spark = groups.sparkSession
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    single = (F.col("bytes") * F.lit(bins) > F.lit(total)) | (F.pmod(F.xxhash64("group", F.lit("loose")), F.lit(max(n, 1))) < loose)
    buckets = max(1, min(bins, -(-n // BUCKET_GROUPS)))
    small = groups.filter(~single).select(F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int").alias("bucket"), "group", "bytes")
    parts = materialize(small.repartition(buckets, "bucket").sortWithinPartitions("bucket", "group").mapInArrow(_parts(shards), PARTS), "shard-parts")
    sums = parts.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")).collect()  # at most bins * shards rows
    items: dict[tuple[int, int], list[int]] = {}
    for r in sorted(sums):
        items.setdefault((0, r.bucket), [0] * shards)[r.part] = r.bytes
    for r in sorted(groups.filter(single).select("group", "bytes").collect()):  # about bins + loose rows at most
        items[1, r.group] = [r.bytes]
    plan = [(kind, key, part, shard) for (kind, key), found in zip(items, differencing(list(items.values()), shards), strict=True) for part, shard in enumerate(found)]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    plan = spark.createDataFrame(plan, schema)
    own = plan.filter("kind = 1").select(F.col("key").alias("group"), "shard")
    dealt = plan.filter("kind = 0").select(F.col("key").cast("int").alias("bucket"), "part", "shard")
    # Both tables made here are bounded as their rows on the driver are.
    return materialize(parts.join(F.broadcast(dealt), ["bucket", "part"]).select("group", "shard").unionByName(own), "shard-plan")


def slots(placed: DataFrame, n_rows: int) -> DataFrame:
    """``placed`` (with shard and row) and its slot: gapless from 0 in each shard."""
    buckets = max(1, -(-n_rows // BUCKET_ROWS) * 8)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    block = (F.col("bucket") / BLOCK).cast("int").alias("block")
    counts = materialize(placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", block, "bucket", "n"), "shard-counts")
    earlier = lambda *of: Window.partitionBy(*of[:-1]).orderBy(of[-1]).rowsBetween(Window.unboundedPreceding, -1)
    # A window holds at most BLOCK buckets, then the blocks of a shard.
    blocks = counts.groupBy("shard", "block").agg(F.sum("n").alias("n")).withColumn("blocks_before", F.coalesce(F.sum("n").over(earlier("shard", "block")), F.lit(0)))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier("shard", "block", "bucket")), F.lit(0)))
    before = before.join(blocks.select("shard", "block", "blocks_before"), ["shard", "block"]).select("shard", "bucket", (F.col("before") + F.col("blocks_before")).alias("before"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "row")
    numbered = placed.withColumn("place", F.row_number().over(order)).join(before, ["shard", "bucket"])
    return numbered.withColumn("slot", (F.col("before") + F.col("place") - 1).cast("long"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, loose: int = LOOSE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, balanced by bytes."""
    small_batches(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "utf-8")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "shard-rows")
    # Two texts of one 64-bit hash would merely stay together.
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    n_rows = rows.count()
    hot = hot_keys(groups.select("group", F.col("n").alias("size")), "group", n_rows)
    placed = join_hot(rows, assign(groups, shards, bins, loose), "group", hot).drop("group")
    return slots(placed, n_rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
