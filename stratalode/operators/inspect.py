"""Bounded listings and details of a store's tables; never their values.

A listing takes one row more than it shows, so that it knows whether it is cut
without counting everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalode import errors as E
from stratalode.functions.scalars import hex_id

DEFAULT, MOST = 10, 100


def bounded(rows: DataFrame, order: list[str], limit: int = DEFAULT) -> dict:
    """{'items': …, 'truncated': …} of the first rows; at most MOST are listed."""
    if not 0 <= limit:
        raise E.InvalidArgument(f"limit {limit}")
    limit = min(limit, MOST)
    found = [r.asDict() for r in rows.orderBy(*order).limit(limit + 1).collect()]
    return {"items": found[:limit], "truncated": len(found) > limit}


def list_objects(objects: DataFrame, limit: int = DEFAULT) -> dict:
    rows = objects.select(hex_id(F.col("object_id")).alias("object_id"), "size_bytes", "chunk_count", "chunker")
    return bounded(rows, ["object_id"], limit)


def object_detail(objects: DataFrame, object_chunks: DataFrame, chunks: DataFrame, object_id: bytes, limit: int = DEFAULT) -> dict:
    """Size, chunk count and the first manifest rows of one object, with the presence of their chunks."""
    key = F.col("object_id") == F.lit(bytearray(object_id))
    head = objects.filter(key).collect()
    if not head:
        raise E.ObjectNotFound(object_id.hex())
    have = chunks.select("chunk_hash", F.lit(True).alias("present"))
    rows = object_chunks.filter(key).join(have, "chunk_hash", "left")
    rows = rows.select("chunk_index", hex_id(F.col("chunk_hash")).alias("chunk_hash"), "offset", "size_bytes", F.coalesce("present", F.lit(False)).alias("present"))
    return {"object_id": object_id.hex(), "size_bytes": head[0].size_bytes, "chunk_count": head[0].chunk_count, "chunks": bounded(rows, ["chunk_index"], limit)}


def list_chunks(chunks: DataFrame, object_chunks: DataFrame, limit: int = DEFAULT) -> dict:
    from stratalode.operators.objects import references

    rows = references(chunks, object_chunks)
    return bounded(rows.select(hex_id(F.col("chunk_hash")).alias("chunk_hash"), "size_bytes", "refs"), ["chunk_hash"], limit)


def chunk_detail(chunks: DataFrame, object_chunks: DataFrame, chunk_hash: bytes, limit: int = DEFAULT) -> dict:
    """Size, and the objects that hold one chunk."""
    key = F.col("chunk_hash") == F.lit(bytearray(chunk_hash))
    head = chunks.filter(key).select("size_bytes").collect()
    if not head:
        raise E.ObjectChunkNotFound(chunk_hash.hex())
    users = object_chunks.filter(key).select(hex_id(F.col("object_id")).alias("object_id"), "chunk_index", "offset")
    return {"chunk_hash": chunk_hash.hex(), "size_bytes": head[0].size_bytes, "objects": bounded(users, ["object_id", "chunk_index"], limit)}


def list_vectors(vectors: DataFrame, collection: str, limit: int = DEFAULT) -> dict:
    rows = vectors.filter(F.col("collection_name") == collection).select("vector_id", "dimensions")
    return bounded(rows, ["vector_id"], limit)


def list_nodes(nodes: DataFrame, graph: str, limit: int = DEFAULT) -> dict:
    rows = nodes.filter(F.col("graph_name") == graph).select("node_id", "kind", "target_type", "created_order")
    return bounded(rows, ["created_order", "node_id"], limit)


def table_columns(table: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in table.schema.fields]
