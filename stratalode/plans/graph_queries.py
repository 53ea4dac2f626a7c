"""Graph queries over the star schema and the same in SQL, with a walk's levels unrolled."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalode.functions.sql import register, with_walks
from stratalode.operators import diagnose
from stratalode.operators import graph as G
from stratalode.operators import vectors as V
from stratalode.plans import tables
from stratalode.plans.vector_queries import _query, _sql
from stratalode.session import stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
CTE = tables.GRAPH_CTE


def _add(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def _graph(spark, sf_dir):
    return tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir)


def _near(where: str, end: str, limit: int) -> str:
    return f"""WITH {CTE}, r AS (SELECT row_number() OVER (ORDER BY e.created_order, n.node_id) AS rank, n.node_id, n.kind, e.edge_type FROM e JOIN n ON n.node_id = e.{end} WHERE {where})
SELECT * FROM r WHERE rank <= {limit}"""


@_add("graph_neighbors_out", _near("e.from_node_id = 'nation:3'", "to_node_id", 25))
def _out(spark, sf_dir):
    return G.neighbors(*_graph(spark, sf_dir), tables.GRAPH, "nation:3", limit=25)


@_add("graph_neighbors_in", _near("e.to_node_id = 'part:5'", "from_node_id", 100))
def _in(spark, sf_dir):
    return G.neighbors(*_graph(spark, sf_dir), tables.GRAPH, "part:5", "incoming", limit=100)


@_add("graph_neighbors_typed", _near("e.from_node_id = 'nation:3' AND e.edge_type = 'has_supplier'", "to_node_id", 10))
def _typed(spark, sf_dir):
    return G.neighbors(*_graph(spark, sf_dir), tables.GRAPH, "nation:3", edge_type="has_supplier", limit=10)


@_add("graph_sql_neighbors", _near("e.from_node_id = 'region:2'", "to_node_id", 10))
def _sql_near(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    register(spark, None, nodes, edges)
    return spark.sql(f"SELECT * FROM graph_neighbors('{tables.GRAPH}', 'region:2')")


def _walk_sql(start: str, depth: int, limit: int, edge: str | None = None) -> str:
    """Levels as CTEs: the first edges of each node, without nodes seen, each node under its first parent."""
    typed = f" WHERE edge_type = '{edge}'" if edge else ""
    ctes = [CTE, f"w AS (SELECT * FROM e{typed})", f"l0 AS (SELECT 1::BIGINT AS rank, node_id, kind, 0::BIGINT AS depth, NULL::VARCHAR AS predecessor_node_id, NULL::VARCHAR AS edge_type FROM n WHERE node_id = '{start}')", "a0 AS (SELECT * FROM l0)"]
    for d in range(1, depth + 1):
        p = d - 1
        ctes += [
            f"f{d} AS (SELECT l.rank AS parent, w.*, row_number() OVER (PARTITION BY w.from_node_id ORDER BY w.created_order, w.to_node_id) AS place FROM w JOIN l{p} l ON l.node_id = w.from_node_id)",
            f"u{d} AS (SELECT f.*, row_number() OVER (PARTITION BY to_node_id ORDER BY parent, created_order) AS r FROM f{d} f WHERE place <= {limit} AND to_node_id NOT IN (SELECT node_id FROM a{p}))",
            f"l{d} AS (SELECT * FROM (SELECT (SELECT max(rank) FROM a{p}) + row_number() OVER (ORDER BY u.parent, u.created_order, u.to_node_id) AS rank, u.to_node_id AS node_id, n.kind, {d}::BIGINT AS depth, u.from_node_id AS predecessor_node_id, u.edge_type FROM u{d} u JOIN n ON n.node_id = u.to_node_id WHERE r = 1) WHERE rank <= {limit})",
            f"a{d} AS (SELECT * FROM a{p} UNION ALL SELECT * FROM l{d})",
        ]
    return f"WITH {', '.join(ctes)} SELECT * FROM a{depth} WHERE rank <= {limit}"


for _name, _start, _depth, _limit, _edge in [
    ("graph_walk_d1", "nation:3", 1, 40, None),
    ("graph_walk_d2", "region:1", 2, 60, None),
    ("graph_walk_d3", "nation:4", 3, 80, None),
    ("graph_walk_limit", "region:1", 4, 7, None),
    ("graph_walk_typed", "region:1", 3, 50, "has_nation"),
]:

    def _run(spark, sf_dir, a=_start, d=_depth, k=_limit, t=_edge):
        nodes, edges = _graph(spark, sf_dir)
        # As in a store, the edges lie in one table: each level reads them again.
        return G.walk(nodes, stored(edges, "edges"), tables.GRAPH, a, d, t, k)

    QUERIES[_name], SQL[_name] = _run, _walk_sql(_start, _depth, _limit, _edge)


@_add("graph_sql_walk", _walk_sql("region:1", 2, 60))
def _sql_walk(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return with_walks(spark, f"SELECT * FROM graph_walk('{tables.GRAPH}', 'region:1', 2, NULL, 60)", nodes, stored(edges, "edges"))


@_add("graph_info", f"WITH {CTE} SELECT '{tables.GRAPH}' AS name, (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count UNION ALL SELECT 'void', 0, 0")
def _info(spark, sf_dir):
    return G.info(spark.createDataFrame([(tables.GRAPH,), ("void",)], "name string"), *_graph(spark, sf_dir))


@_add(
    "graph_delete_node",
    f"WITH {CTE} SELECT edge_type, count(*) AS n FROM e WHERE from_node_id <> 'nation:3' AND to_node_id <> 'nation:3' GROUP BY edge_type",
)
def _delete(spark, sf_dir):
    _, edges = G.without_node(*_graph(spark, sf_dir), tables.GRAPH, "nation:3")
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


@_add(
    "graph_rag",
    f"""WITH {CTE}, hits AS ({_sql("cosine", "", 5)}), c AS (SELECT rank, 'customer:' || vector_id AS node_id, distance FROM hits)
SELECT c.rank, c.node_id, o.o_orderkey, o.o_totalprice FROM c JOIN e ON e.from_node_id = c.node_id AND e.edge_type = 'placed' JOIN orders o ON 'orders:' || o.o_orderkey = e.to_node_id""",
)
def _rag(spark, sf_dir):
    """Vector hits, their neighbours in the graph, and the records these stand for."""
    hits = V.search(tables.vectors(spark, sf_dir), _query(spark, sf_dir), "cosine", 5)
    c = hits.select("rank", F.concat(F.lit("customer:"), "vector_id").alias("from_node_id"))
    near = tables.edges(spark, sf_dir).filter("edge_type = 'placed'").join(F.broadcast(c), "from_node_id")
    orders = table(spark, sf_dir, "orders")
    key = F.substring_index("to_node_id", ":", -1).cast("long")
    return near.withColumn("o_orderkey", key).join(orders, "o_orderkey").select("rank", F.col("from_node_id").alias("node_id"), "o_orderkey", "o_totalprice")


@_add("graph_conversation_replies", "SELECT conv_id, count(*) - 1 AS replies, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def _replies(spark, sf_dir):
    """A conversation's turns as a chain of replies: each turn but the first has an edge to the one before."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    chain = c.select("conv_id", "turn", F.lag("turn").over(w).alias("before"))
    return chain.groupBy("conv_id").agg(F.count("before").alias("replies"), F.max("turn").alias("last_turn"))


@_add(
    "diag_edges_missing",
    f"""WITH {CTE}, left_n AS (SELECT * FROM n WHERE kind <> 'supplier')
SELECT 'missing_edge_to_node' AS kind, e.edge_type, e.to_node_id AS node_id FROM e LEFT JOIN left_n ON left_n.node_id = e.to_node_id WHERE left_n.node_id IS NULL""",
)
def _lost(spark, sf_dir):
    """Issues after all suppliers were lost."""
    nodes, edges = _graph(spark, sf_dir)
    graphs = spark.createDataFrame([(tables.GRAPH, 1)], "name string, created_order long")
    return diagnose.graph_issues(graphs, nodes.filter("kind <> 'supplier'"), edges).select("kind", "edge_type", "node_id")
