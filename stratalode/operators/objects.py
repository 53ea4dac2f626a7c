"""Content-addressed objects: bytes are cut into chunks, chunks are stored once.

Tables: objects (object_id, size_bytes, chunk_count, chunker), chunks
(chunk_hash, size_bytes, data), object_chunks (object_id, chunk_index,
chunk_hash, offset, size_bytes).  Hashing, deduplication and checks are SQL
expressions; only the cutting and the joining of bytes are Arrow functions.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalode.functions import fastcdc
from stratalode.functions.scalars import content_id
from stratalode.schemas import CHUNKS, OBJECT_CHUNKS, OBJECTS

PIECES = T.StructType([T.StructField("object_id", T.BinaryType()), T.StructField("chunk_index", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("data", T.BinaryType())])


def fixed(size: int) -> Callable[[bytes], list[tuple[int, int]]]:
    """Boundaries every ``size`` bytes, for comparison with SQL."""
    return lambda data: [(i, min(size, len(data) - i)) for i in range(0, len(data), size)]


def cut(objects: DataFrame, boundaries: Callable[[bytes], list[tuple[int, int]]] = fastcdc.boundaries) -> DataFrame:
    """PIECES of the rows (object_id, data)."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                ids, index, offsets, pieces = [], [], [], []
                for who, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    data = data.as_py() or b""
                    for i, (at, n) in enumerate(boundaries(data)):
                        ids.append(who)
                        index.append(i)
                        offsets.append(at)
                        pieces.append(data[at : at + n])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(index, pa.int64()), pa.array(offsets, pa.int64()), pa.array(pieces, pa.binary())], names=PIECES.names)

    return objects.select("object_id", "data").mapInArrow(run, PIECES)


def with_ids(blobs: DataFrame, data_col: str = "data") -> DataFrame:
    """One row (object_id, data) for each distinct content; null contents are left out."""
    rows = blobs.filter(F.col(data_col).isNotNull()).select(content_id(F.col(data_col)).alias("object_id"), F.col(data_col).alias("data"))
    return rows.groupBy("object_id").agg(F.first("data").alias("data"))  # equal bytes: one row leaves each task


def put(blobs: DataFrame, objects: DataFrame, chunks: DataFrame, object_chunks: DataFrame, data_col: str = "data", boundaries=fastcdc.boundaries) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to append to the three tables so that all ``blobs`` are objects; contents that are there add nothing."""
    new = with_ids(blobs, data_col).join(objects.select("object_id"), "object_id", "left_anti")
    pieces = cut(new, boundaries).withColumn("chunk_hash", content_id(F.col("data"))).withColumn("size_bytes", F.octet_length("data").cast("long"))
    sizes = new.select("object_id", F.octet_length("data").cast("long").alias("size_bytes"))
    counts = pieces.groupBy("object_id").agg(F.count("*").alias("n"))
    heads = sizes.join(counts, "object_id", "left").select("object_id", "size_bytes", F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"), F.lit(fastcdc.CHUNKER).alias("chunker"))
    stored = pieces.groupBy("chunk_hash").agg(F.first("size_bytes").alias("size_bytes"), F.first("data").alias("data")).join(chunks.select("chunk_hash"), "chunk_hash", "left_anti")
    return heads.select(*OBJECTS.names), stored.select(*CHUNKS.names), pieces.select(*OBJECT_CHUNKS.names)


def assemble(object_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(object_id, data) of every object in ``object_chunks``, its chunks joined in order.

    Each object is put together in one task from rows sorted by index; a missing
    chunk gives null data.  Objects without chunks are empty and are not here.
    """
    return _joined(object_chunks.join(chunks.select("chunk_hash", "data"), "chunk_hash", "left"))


def _joined(rows: DataFrame) -> DataFrame:
    """(object_id, data): the data of rows (object_id, chunk_index, data) joined in order; null if one is."""
    rows = rows.select("object_id", "chunk_index", "data")
    rows = rows.repartition("object_id").sortWithinPartitions("object_id", "chunk_index")

    def run(batches):
        who, held = None, []

        def done():
            data = None if any(x is None for x in held) else b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([who], pa.binary()), pa.array([data], pa.binary())], names=["object_id", "data"])

        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(2), strict=True):
                key = key.as_py()
                if key != who:
                    if who is not None:
                        yield done()
                    who, held = key, []
                held.append(data.as_py())
        if who is not None:
            yield done()

    return rows.mapInArrow(run, "object_id binary, data binary")


def get(objects: DataFrame, chunks: DataFrame, object_chunks: DataFrame) -> DataFrame:
    """(object_id, data, sound): sound if the bytes have the object's size and hash."""
    made = assemble(object_chunks, chunks)
    rows = objects.select("object_id", "size_bytes", "chunk_count").join(made, "object_id", "left")
    data = F.when(F.col("chunk_count") == 0, F.lit(b"")).otherwise(F.col("data"))
    sound = (F.octet_length("data") == F.col("size_bytes")) & (content_id(F.col("data")) == F.col("object_id"))
    return rows.withColumn("data", data).select("object_id", "data", F.coalesce(sound, F.lit(False)).alias("sound"))


def range_rows(object_chunks: DataFrame, chunks: DataFrame, offset: int, length: int) -> DataFrame:
    """The chunks that overlap a byte range, each cut to it: (object_id, chunk_index, chunk_hash, data, sound)."""
    end = offset + length
    rows = object_chunks.filter((F.col("offset") + F.col("size_bytes") > offset) & (F.col("offset") < end))
    rows = rows.join(chunks.select("chunk_hash", "data"), "chunk_hash", "left")
    low = F.greatest(F.lit(offset), F.col("offset")) - F.col("offset")
    high = F.least(F.lit(end), F.col("offset") + F.col("size_bytes")) - F.col("offset")
    sound = (F.octet_length("data") == F.col("size_bytes")) & (content_id(F.col("data")) == F.col("chunk_hash"))
    return rows.select("object_id", "chunk_index", "chunk_hash", F.substring("data", (low + 1).cast("int"), (high - low).cast("int")).alias("data"), F.coalesce(sound, F.lit(False)).alias("sound"))


def read_range(objects: DataFrame, object_chunks: DataFrame, chunks: DataFrame, offset: int, length: int) -> DataFrame:
    """(object_id, data): that range of every object; shorter at its end, null where the offset is beyond it."""
    rows = range_rows(object_chunks, chunks, offset, length)
    parts = _joined(rows)
    data = F.when(F.col("size_bytes") < offset, F.lit(None).cast("binary")).otherwise(F.coalesce("data", F.lit(b"")))
    return objects.select("object_id", "size_bytes").join(parts, "object_id", "left").select("object_id", data.alias("data"))


def manifest_shape(objects: DataFrame, object_chunks: DataFrame) -> DataFrame:
    """(object_id, sound): indexes run from 0 without gaps, offsets are the sums of the sizes before, totals agree."""
    w = Window.partitionBy("object_id").orderBy("chunk_index")
    rows = object_chunks.withColumn("want_index", F.row_number().over(w) - 1).withColumn("want_offset", F.coalesce(F.sum("size_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    good = (F.col("chunk_index") == F.col("want_index")) & (F.col("offset") == F.col("want_offset")) & F.col("size_bytes").between(1, fastcdc.MAX)
    shape = rows.groupBy("object_id").agg(F.min(good.cast("int")).alias("good"), F.count("*").alias("n"), F.sum("size_bytes").alias("total"))
    out = objects.join(shape, "object_id", "left")
    sound = (F.coalesce("n", F.lit(0)) == F.col("chunk_count")) & (F.coalesce("total", F.lit(0)) == F.col("size_bytes")) & (F.coalesce("good", F.lit(1)) == 1)
    return out.select("object_id", sound.alias("sound"))


def loose_chunks(chunks: DataFrame, object_chunks: DataFrame) -> DataFrame:
    return chunks.join(object_chunks.select("chunk_hash"), "chunk_hash", "left_anti")


def references(chunks: DataFrame, object_chunks: DataFrame) -> DataFrame:
    """(chunk_hash, size_bytes, refs) of every chunk."""
    n = object_chunks.groupBy("chunk_hash").agg(F.count("*").alias("n"))
    return chunks.select("chunk_hash", "size_bytes").join(n, "chunk_hash", "left").select("chunk_hash", "size_bytes", F.coalesce("n", F.lit(0)).cast("long").alias("refs"))


def dead_chunks(object_chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """(chunk_hash) of the chunks that only the objects ``gone`` (object_id) refer to."""
    theirs = object_chunks.join(gone, "object_id", "left_semi").select("chunk_hash").distinct()
    return theirs.join(object_chunks.join(gone, "object_id", "left_anti").select("chunk_hash"), "chunk_hash", "left_anti")


def delete(objects: DataFrame, chunks: DataFrame, object_chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the objects ``gone`` (object_id) and the chunks that only they referred to; loose chunks stay."""
    ids = gone.select("object_id").distinct()
    left = object_chunks.join(ids, "object_id", "left_anti")
    dead = dead_chunks(object_chunks, ids)
    return objects.join(ids, "object_id", "left_anti").select(*objects.columns), chunks.join(dead, "chunk_hash", "left_anti").select(*chunks.columns), left.select(*object_chunks.columns)


def stats(objects: DataFrame, chunks: DataFrame, object_chunks: DataFrame) -> DataFrame:
    """One row: counts, sizes, loose chunks and the bytes that deduplication saves."""

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    o = objects.agg(F.count("*").alias("object_count"), total(F.col("size_bytes")).alias("object_bytes"), F.coalesce(F.min("size_bytes"), F.lit(0)).alias("min_size"), F.coalesce(F.max("size_bytes"), F.lit(0)).alias("max_size"))
    c = references(chunks, object_chunks).agg(F.count("*").alias("chunk_count"), total(F.col("size_bytes")).alias("chunk_bytes"), total((F.col("refs") == 0).cast("long")).alias("loose_chunk_count"))
    m = object_chunks.agg(F.count("*").alias("manifest_rows"), total(F.col("size_bytes")).alias("manifest_bytes"))
    one = o.crossJoin(c).crossJoin(m)  # single rows
    return one.withColumn("dedup_saved_bytes", F.greatest(F.lit(0), F.col("manifest_bytes") - F.col("chunk_bytes")).cast("long"))
