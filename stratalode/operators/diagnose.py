"""Diagnostics: every damaged row of the private tables as an issue row, and what salvage can keep.

Issues come from filters and anti-joins; they are complete, and bounded lists
are a matter of the caller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalode import validate
from stratalode.functions.scalars import content_id, hex_id
from stratalode.operators import objects as O

COLUMNS = ("object_id_hex", "chunk_hash_hex", "collection_name", "vector_id", "graph_name", "node_id", "edge_type")
BAD_SYMBOL = rf"^(?!(?i:{validate.RESERVED})){validate.SYMBOL}\z"


def _issues(df: DataFrame, area: str, kind: str, detail: str, **columns: Column) -> DataFrame:
    return df.select(
        F.lit(area).alias("area"), F.lit(kind).alias("kind"), F.lit("error").alias("severity"), F.lit(detail).alias("detail"),
        *[(columns[c] if c in columns else F.lit(None)).cast("string").alias(c) for c in COLUMNS],
    )


def bad_symbol(c: Column) -> Column:
    return ~F.coalesce(c.rlike(BAD_SYMBOL), F.lit(False))


def bad_id(c: Column, most: int) -> Column:
    sound = F.octet_length(c).between(1, most) & ~F.lower(c).startswith(validate.RESERVED) & ~F.contains(c, F.lit("\0"))
    return ~F.coalesce(sound, F.lit(False))


def object_issues(objects: DataFrame, chunks: DataFrame, object_chunks: DataFrame, deep: bool = True) -> DataFrame:
    shape = objects.filter(F.octet_length("object_id") != 32)
    out = [_issues(shape, "object", "object_id_shape", "an object id has not 32 bytes", object_id_hex=hex_id(F.col("object_id")))]
    bad = O.manifest_shape(objects, object_chunks).filter(~F.col("sound"))
    out.append(_issues(bad, "object", "object_manifest", "the manifest is not contiguous or complete", object_id_hex=hex_id(F.col("object_id"))))
    missing = object_chunks.join(chunks.select("chunk_hash"), "chunk_hash", "left_anti")
    out.append(_issues(missing, "chunk", "missing_chunk", "a manifest names a chunk that is not there", object_id_hex=hex_id(F.col("object_id")), chunk_hash_hex=hex_id(F.col("chunk_hash"))))
    out.append(_issues(missing.filter(F.octet_length("chunk_hash") != 32), "chunk", "missing_chunk_id_shape", "the id of a missing chunk has not 32 bytes", object_id_hex=hex_id(F.col("object_id")), chunk_hash_hex=hex_id(F.col("chunk_hash"))))
    if deep:
        sound = (F.octet_length("data") == F.col("size_bytes")) & F.col("size_bytes").between(1, validate.MAX_CHUNK) & (content_id(F.col("data")) == F.col("chunk_hash"))
        damaged = chunks.filter(~F.coalesce(sound, F.lit(False))).select("chunk_hash")
        used = object_chunks.join(damaged, "chunk_hash", "left_semi").select("object_id", "chunk_hash")
        out.append(_issues(used, "chunk", "chunk_integrity", "chunk bytes do not have their hash or size", object_id_hex=hex_id(F.col("object_id")), chunk_hash_hex=hex_id(F.col("chunk_hash"))))
        out.append(_issues(used.select("object_id").distinct(), "object", "object_integrity", "the object has damaged chunks", object_id_hex=hex_id(F.col("object_id"))))
        loose = damaged.join(object_chunks.select("chunk_hash"), "chunk_hash", "left_anti")
        out.append(_issues(loose, "chunk", "loose_chunk_integrity", "loose chunk bytes do not have their hash or size", chunk_hash_hex=hex_id(F.col("chunk_hash"))))
        short = O.loose_chunks(chunks, object_chunks).filter(F.octet_length("chunk_hash") != 32)
        out.append(_issues(short, "chunk", "loose_chunk_id_shape", "the id of a loose chunk has not 32 bytes", chunk_hash_hex=hex_id(F.col("chunk_hash"))))
    return reduce(DataFrame.unionByName, out)


def unsound_vectors(collections: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows of ``vectors`` with another length, a value that is not finite, no norm under cosine, or no collection."""
    c = collections.select(F.col("name").alias("collection_name"), F.col("dimensions").alias("want"), "metric")
    norm = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    finite = ~F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    sound = (F.col("dimensions") == F.col("want")) & (F.size("values") == F.col("want")) & finite & ((F.col("metric") != "cosine") | (norm > 0))
    return vectors.join(F.broadcast(c) if c.limit(10_001).count() <= 10_000 else c, "collection_name", "left").filter(~F.coalesce(sound, F.lit(False))).select(*vectors.columns)


def vector_issues(collections: DataFrame, vectors: DataFrame) -> DataFrame:
    return _issues(unsound_vectors(collections, vectors), "vector", "vector_integrity", "values do not fit the collection", collection_name=F.col("collection_name"), vector_id=F.col("vector_id"))


def graph_issues(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    g, n = {"graph_name": F.col("graph_name")}, {"graph_name": F.col("graph_name"), "node_id": F.col("node_id")}
    e = {"graph_name": F.col("graph_name"), "edge_type": F.col("edge_type")}
    null = lambda c: F.coalesce(F.contains(F.col(c), F.lit("\0")), F.lit(False))
    out = [
        _issues(graphs.filter(bad_symbol(F.col("name"))), "graph", "graph_name_invalid", "invalid graph name", graph_name=F.col("name")),
        _issues(nodes.filter(bad_symbol(F.col("graph_name"))), "graph", "node_graph_name_invalid", "invalid graph name of a node", **n),
        _issues(nodes.filter(bad_id(F.col("node_id"), 512)), "graph", "node_id_invalid", "invalid node id", **n),
        _issues(nodes.filter(bad_symbol(F.col("kind"))), "graph", "node_kind_invalid", "invalid node kind", **n),
        _issues(nodes.filter(~F.coalesce(F.col("target_type").isin(*validate.TARGET_TYPES), F.lit(False))), "graph", "node_target_type_invalid", "invalid target type", **n),
        _issues(nodes.filter(null("target_namespace")), "graph", "node_target_namespace_invalid", "invalid target namespace", **n),
        _issues(nodes.filter(null("target_ref")), "graph", "node_target_ref_invalid", "invalid target reference", **n),
        _issues(edges.filter(bad_symbol(F.col("graph_name"))), "graph", "edge_graph_name_invalid", "invalid graph name of an edge", **e),
        _issues(edges.filter(bad_id(F.col("from_node_id"), 512)), "graph", "edge_from_node_invalid", "invalid start of an edge", node_id=F.col("from_node_id"), **e),
        _issues(edges.filter(bad_id(F.col("to_node_id"), 512)), "graph", "edge_to_node_invalid", "invalid end of an edge", node_id=F.col("to_node_id"), **e),
        _issues(edges.filter(bad_symbol(F.col("edge_type"))), "graph", "edge_type_invalid", "invalid edge type", **e),
    ]
    ids = nodes.select("graph_name", "node_id")
    for end, kind in (("from_node_id", "missing_edge_from_node"), ("to_node_id", "missing_edge_to_node")):
        lost = edges.join(ids.withColumnRenamed("node_id", end), ["graph_name", end], "left_anti")
        out.append(_issues(lost, "graph", kind, "an edge ends at a node that is not there", node_id=F.col(end), **e))
    return reduce(DataFrame.unionByName, out)


def lost_targets(nodes: DataFrame, objects: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes whose owned target (object, chunk, vector) is not there, with ``kind`` of the issue."""
    key = ["graph_name", "node_id"]
    out = []
    for target, kind, table, column in (("object", "node_object_target", objects, "object_id"), ("object_chunk", "node_chunk_target", chunks, "chunk_hash")):
        own = nodes.filter(F.col("target_type") == target)
        good = F.coalesce(F.col("target_ref").rlike("^[0-9A-Fa-f]{64}\\z"), F.lit(False))
        out.append(own.filter(~good).select(*key, F.lit(f"{kind}_invalid").alias("issue")))
        have = table.select(hex_id(F.col(column)).alias("ref"))
        out.append(own.filter(good).withColumn("ref", F.lower("target_ref")).join(have, "ref", "left_anti").select(*key, F.lit(f"{kind}_missing").alias("issue")))
    own = nodes.filter(F.col("target_type") == "vector")
    have = vectors.select(F.col("collection_name").alias("target_namespace"), F.col("vector_id").alias("target_ref"))
    out.append(own.join(have, ["target_namespace", "target_ref"], "left_anti").select(*key, F.lit("node_vector_target_missing").alias("issue")))
    return reduce(DataFrame.unionByName, out)


def target_issues(nodes: DataFrame, objects: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    lost = lost_targets(nodes, objects, chunks, vectors)
    return lost.select(
        F.lit("graph").alias("area"), F.col("issue").alias("kind"), F.lit("error").alias("severity"), F.lit("a node's target is not there").alias("detail"),
        *[(F.col(c) if c in ("graph_name", "node_id") else F.lit(None)).cast("string").alias(c) for c in COLUMNS],
    )


def all_issues(t: dict[str, DataFrame], deep: bool = True) -> DataFrame:
    """Every issue of the private tables ``t``."""
    parts = [
        object_issues(t["objects"], t["chunks"], t["object_chunks"], deep),
        vector_issues(t["vector_collections"], t["vectors"]),
        graph_issues(t["graphs"], t["graph_nodes"], t["graph_edges"]),
        target_issues(t["graph_nodes"], t["objects"], t["chunks"], t["vectors"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def salvage_plan(counts: dict[str, int], issues: dict[str, int]) -> dict:
    """What salvage can recover, from table counts and issue counts by area."""
    skipped = {"objects": min(counts["objects"], issues.get("object", 0)), "chunks": issues.get("chunk", 0), "vectors": min(counts["vectors"], issues.get("vector", 0)), "graph_edges": min(counts["graph_edges"], issues.get("graph", 0))}
    left = {k: max(0, n - skipped.get(k, 0)) for k, n in counts.items()}
    if issues.get("storage", 0):
        state = "unknown"
    elif not any(issues.values()):
        state = "recoverable"
    else:
        state = "partially_recoverable" if any(left.values()) else "not_recoverable"
    return {"recoverability": state, "recoverable": left, "skipped": skipped}


def salvaged(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The private tables with sound rows only; nodes need their targets, edges both ends."""
    sound = (F.octet_length("data") == F.col("size_bytes")) & (F.octet_length("chunk_hash") == 32) & (content_id(F.col("data")) == F.col("chunk_hash"))
    chunks = t["chunks"].filter(F.coalesce(sound, F.lit(False)))
    good = O.manifest_shape(t["objects"], t["object_chunks"]).filter("sound").select("object_id")
    broken = t["object_chunks"].join(chunks.select("chunk_hash"), "chunk_hash", "left_anti").select("object_id")
    objects = t["objects"].join(good, "object_id", "left_semi").join(broken, "object_id", "left_anti")
    manifests = t["object_chunks"].join(objects.select("object_id"), "object_id", "left_semi")
    bad = unsound_vectors(t["vector_collections"], t["vectors"]).select("collection_name", "vector_id")
    vectors = t["vectors"].join(bad, ["collection_name", "vector_id"], "left_anti")
    graphs = t["graphs"].filter(~bad_symbol(F.col("name")))
    nodes = t["graph_nodes"].filter(~bad_symbol(F.col("graph_name")) & ~bad_id(F.col("node_id"), 512) & ~bad_symbol(F.col("kind")) & F.col("target_type").isin(*validate.TARGET_TYPES))
    nodes = nodes.join(lost_targets(nodes, objects, chunks, vectors).select("graph_name", "node_id"), ["graph_name", "node_id"], "left_anti")
    ids = nodes.select("graph_name", "node_id")
    edges = t["graph_edges"].filter(~bad_symbol(F.col("edge_type")))
    for end in ("from_node_id", "to_node_id"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), ["graph_name", end], "left_semi")
    out = {"objects": objects, "chunks": chunks, "object_chunks": manifests, "vector_collections": t["vector_collections"], "vectors": vectors, "graphs": graphs, "graph_nodes": nodes, "graph_edges": edges}
    return {k: df.select(*t[k].columns) for k, df in out.items()}
