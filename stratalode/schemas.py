"""The private tables of a store; checked exactly when one is opened."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*columns: tuple[str, str]) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(), "floats": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in columns])


OBJECTS = _table(("object_id", "binary"), ("size_bytes", "long"), ("chunk_count", "long"), ("chunker", "string"))
CHUNKS = _table(("chunk_hash", "binary"), ("size_bytes", "long"), ("data", "binary"))
OBJECT_CHUNKS = _table(("object_id", "binary"), ("chunk_index", "long"), ("chunk_hash", "binary"), ("offset", "long"), ("size_bytes", "long"))
VECTOR_COLLECTIONS = _table(("name", "string"), ("dimensions", "int"), ("metric", "string"), ("element_type", "string"))
VECTORS = _table(("collection_name", "string"), ("vector_id", "string"), ("dimensions", "int"), ("values", "floats"))
GRAPHS = _table(("name", "string"), ("created_order", "long"))
GRAPH_NODES = _table(("graph_name", "string"), ("node_id", "string"), ("kind", "string"), ("target_type", "string"), ("target_namespace", "string"), ("target_ref", "string"), ("created_order", "long"))
GRAPH_EDGES = _table(("graph_name", "string"), ("from_node_id", "string"), ("edge_type", "string"), ("to_node_id", "string"), ("created_order", "long"))

OBJECT_TABLES = {"objects": OBJECTS, "chunks": CHUNKS, "object_chunks": OBJECT_CHUNKS}
VECTOR_TABLES = {"vector_collections": VECTOR_COLLECTIONS, "vectors": VECTORS}
GRAPH_TABLES = {"graphs": GRAPHS, "graph_nodes": GRAPH_NODES, "graph_edges": GRAPH_EDGES}
PRIVATE = {**OBJECT_TABLES, **VECTOR_TABLES, **GRAPH_TABLES}
