"""The driver tables as the private tables of a store: vectors, a graph, objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.functions.scalars import content_id
from stratalode.session import table

GRAPH = "star"
#: Orders of the edge types start here, so that edges are in order of type, then of key.
STEP = 10**17


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("emb").alias("collection_name"), F.col("vec_id").cast("string").alias("vector_id"), F.size("embedding").alias("dimensions"), F.col("embedding").alias("values"), "label")


def collections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("emb", 64, "cosine", "f32"), ("void", 8, "l2", "f32")], "name string, dimensions int, metric string, element_type string")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


NODES = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"), ("part", "p_partkey")]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, t).select(F.lit(GRAPH).alias("graph_name"), _id(t, key).alias("node_id"), F.lit(t).alias("kind"), F.lit("record").alias("target_type"), F.lit(t).alias("target_namespace"), F.col(key).cast("string").alias("target_ref"), (F.col(key).cast("long") + i * STEP).alias("created_order"))
        for i, (t, key) in enumerate(NODES)
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -has_nation-> nation -has_customer / has_supplier-> …, customer -placed-> orders -contains-> part."""

    def part(i: int, name: str, t: str, start: Column, end: Column, order: Column, unique: bool = False) -> DataFrame:
        rows = table(spark, sf_dir, t).select(F.lit(GRAPH).alias("graph_name"), start.alias("from_node_id"), F.lit(name).alias("edge_type"), end.alias("to_node_id"), (order.cast("long") + i * STEP).alias("created_order"))
        return rows.distinct() if unique else rows

    parts = [
        part(0, "has_nation", "nation", _id("region", "n_regionkey"), _id("nation", "n_nationkey"), F.col("n_nationkey")),
        part(1, "has_customer", "customer", _id("nation", "c_nationkey"), _id("customer", "c_custkey"), F.col("c_custkey")),
        part(2, "has_supplier", "supplier", _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), F.col("s_suppkey")),
        part(3, "placed", "orders", _id("customer", "o_custkey"), _id("orders", "o_orderkey"), F.col("o_orderkey")),
        part(4, "contains", "lineitem", _id("orders", "l_orderkey"), _id("part", "l_partkey"), F.col("l_orderkey") * 100_000_000 + F.col("l_partkey"), True),
    ]
    return reduce(DataFrame.unionByName, parts)


NODES_SQL = " UNION ALL ".join(f"SELECT '{GRAPH}' AS graph_name, '{t}:' || {k} AS node_id, '{t}' AS kind, {k}::BIGINT + {i * STEP} AS created_order FROM {t}" for i, (t, k) in enumerate(NODES))
EDGES_SQL = f"""
SELECT 'region:' || n_regionkey AS from_node_id, 'has_nation' AS edge_type, 'nation:' || n_nationkey AS to_node_id, n_nationkey::BIGINT AS created_order FROM nation
UNION ALL SELECT 'nation:' || c_nationkey, 'has_customer', 'customer:' || c_custkey, c_custkey + {STEP} FROM customer
UNION ALL SELECT 'nation:' || s_nationkey, 'has_supplier', 'supplier:' || s_suppkey, s_suppkey + {2 * STEP} FROM supplier
UNION ALL SELECT 'customer:' || o_custkey, 'placed', 'orders:' || o_orderkey, o_orderkey + {3 * STEP} FROM orders
UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'contains', 'part:' || l_partkey, l_orderkey * 100000000 + l_partkey + {4 * STEP} FROM lineitem"""
GRAPH_CTE = f"n AS ({NODES_SQL}), e AS ({EDGES_SQL})"


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, data) of the documents' texts as bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))


def object_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blobs(spark, sf_dir)
    return b.select("doc_id", content_id(F.col("data")).alias("object_id"), F.octet_length("data").cast("long").alias("size_bytes"))
