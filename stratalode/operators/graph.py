"""Graph operators over node and edge rows of one or many graphs.

Edges: graph_name, from_node_id, edge_type, to_node_id, created_order.  A walk
is one small job a level; a level, like the result, has at most ``limit`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalode import errors as E
from stratalode import validate
from stratalode.operators.vectors import BROADCAST_ROWS

WALK = "rank long, node_id string, kind string, depth long, predecessor_node_id string, edge_type string"


def neighbors(nodes: DataFrame, edges: DataFrame, graph: str, node_id: str, direction: str = "outgoing", edge_type: str | None = None, limit: int = 10, check: bool = True) -> DataFrame:
    """rank, node_id, kind, edge_type: one row an edge, in the order the edges were made."""
    validate.graph_name(graph)
    validate.node_id(node_id)
    validate.direction(direction)
    validate.limit(limit, E.GraphInvalid)
    if edge_type is not None:
        validate.edge_type(edge_type)
    here, there = ("from_node_id", "to_node_id") if direction == "outgoing" else ("to_node_id", "from_node_id")
    own = nodes.filter(F.col("graph_name") == graph)
    if check and not own.filter(F.col("node_id") == node_id).limit(1).count():
        raise E.GraphNodeNotFound(node_id)
    near = edges.filter((F.col("graph_name") == graph) & (F.col(here) == node_id))
    if edge_type is not None:
        near = near.filter(F.col("edge_type") == edge_type)
    found = near.select(F.col(there).alias("node_id"), "edge_type", "created_order").join(own.select("node_id", "kind"), "node_id")
    found = found.orderBy("created_order", "node_id").limit(limit)
    return found.select(F.row_number().over(Window.orderBy("created_order", "node_id")).cast("long").alias("rank"), "node_id", "kind", "edge_type")


def walk(nodes: DataFrame, edges: DataFrame, graph: str, start: str, max_depth: int = 1, edge_type: str | None = None, limit: int = 10) -> DataFrame:
    """Breadth-first walk over outgoing edges: rank, node_id, kind, depth, predecessor_node_id, edge_type.

    The start comes first.  A node's first ``limit`` edges count, before nodes seen
    already are left out; a node belongs to whoever reaches it first in the
    order (rank of the parent, order of the edge, id).
    """
    validate.graph_name(graph)
    validate.node_id(start)
    validate.limit(limit, E.GraphInvalid)
    validate.limit(max_depth, E.GraphInvalid)
    if edge_type is not None:
        validate.edge_type(edge_type)
    spark = nodes.sparkSession
    own = nodes.filter(F.col("graph_name") == graph).select("node_id", "kind")
    near = edges.filter(F.col("graph_name") == graph)
    if edge_type is not None:
        near = near.filter(F.col("edge_type") == edge_type)
    near = near.select("from_node_id", "edge_type", "to_node_id", "created_order")
    first = own.filter(F.col("node_id") == start).limit(1).collect()
    if not first:
        raise E.GraphNodeNotFound(start)
    rows = [(1, start, first[0].kind, 0, None, None)][:limit]
    level = list(rows)
    for depth in range(1, max_depth + 1):
        if not level or len(rows) >= limit:
            break
        frontier = spark.createDataFrame([(r[1], r[0]) for r in level], "from_node_id string, parent long")
        seen = spark.createDataFrame([(r[1],) for r in rows], "node_id string")
        if len(rows) <= BROADCAST_ROWS:
            frontier, seen = F.broadcast(frontier), F.broadcast(seen)
        out = near.join(frontier, "from_node_id").join(own.withColumnRenamed("node_id", "to_node_id"), "to_node_id")
        place = F.row_number().over(Window.partitionBy("from_node_id").orderBy("created_order", "to_node_id"))
        out = out.withColumn("place", place).filter(F.col("place") <= limit).withColumnRenamed("to_node_id", "node_id").join(seen, "node_id", "left_anti")
        best = F.min(F.struct("parent", "created_order", "edge_type", "from_node_id", "kind")).alias("best")
        out = out.groupBy("node_id").agg(best).orderBy("best.parent", "best.created_order", "node_id").limit(limit - len(rows))
        level = [(len(rows) + i, r.node_id, r.best.kind, depth, r.best.from_node_id, r.best.edge_type) for i, r in enumerate(out.collect(), 1)]
        rows += level
    return spark.createDataFrame(rows, WALK)


def info(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, node_count, edge_count of every graph."""
    n = nodes.groupBy(F.col("graph_name").alias("name")).agg(F.count("*").alias("n"))
    m = edges.groupBy(F.col("graph_name").alias("name")).agg(F.count("*").alias("m"))
    out = graphs.select("name").join(n, "name", "left").join(m, "name", "left")
    return out.select("name", F.coalesce("n", F.lit(0)).cast("long").alias("node_count"), F.coalesce("m", F.lit(0)).cast("long").alias("edge_count"))


def without_node(nodes: DataFrame, edges: DataFrame, graph: str, node_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without a node and the edges at either end of it."""
    mine = F.col("graph_name") == graph
    return nodes.filter(~(mine & (F.col("node_id") == node_id))), edges.filter(~(mine & ((F.col("from_node_id") == node_id) | (F.col("to_node_id") == node_id))))


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` and those of ``new`` (graph_name, from_node_id, edge_type, to_node_id) that are not there; others change nothing."""
    key = ["graph_name", "from_node_id", "edge_type", "to_node_id"]
    fresh = new.select(*key).distinct().join(edges, key, "left_anti")
    top = edges.groupBy("graph_name").agg(F.max("created_order").alias("top"))  # orders run inside each graph
    order = F.row_number().over(Window.partitionBy("graph_name").orderBy(*key[1:])) + F.coalesce("top", F.lit(0))
    return edges.unionByName(fresh.join(top, "graph_name", "left").select(*key, order.cast("long").alias("created_order")))
