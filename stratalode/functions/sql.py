"""SQL functions on a session, so that plain SQL can search vectors and graphs.

``register`` makes temporary functions over views of the tables:

* ``vector_search_<metric>(collection, query, source, k, max_distance)``: a table
  (rank, vector_id, distance), also in ``LATERAL`` joins;
* ``vector_distance_<metric>(query, vector)``: a scalar of two float arrays;
* ``stored_distance_<metric>(collection, id, query)`` and
  ``stored_distance_by_id_<metric>(collection, id, source)``: scalars of stored
  vectors; an id that is not there is an error;
* ``graph_neighbors(graph, node, direction, edge_type, k)``: a table;
* ``content_id(data)``, ``hex_id(data)``, ``zeroblob(n)``, ``glob_match(pattern, text)``.

``with_walks`` runs a statement that calls ``graph_walk(graph, start, max_depth,
edge_type, k)`` as a table: a walk needs one job a level, so calls are computed
before the statement, and their arguments are constants.

Wrong combinations of arguments raise from inside the plan.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from stratalode import errors as E
from stratalode.operators import graph
from stratalode.validate import METRICS

WALK = re.compile(r"\bgraph_walk\s*\(((?:[^()']|'(?:[^'\\]|\\.|'')*+')*+)\)", re.IGNORECASE)

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS double) * cast(y AS double)), 0D, (s, x) -> s + x)"


def distance_sql(metric: str, a: str, b: str) -> str:
    dot = _DOT.format(a=a, b=b)
    if metric == "dot":
        return f"-{dot}"
    if metric == "l2":
        return f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (cast(x AS double) - cast(y AS double)) * (cast(x AS double) - cast(y AS double))), 0D, (s, x) -> s + x))"
    return f"1 - {dot} / (sqrt({_DOT.format(a=a, b=a)}) * sqrt({_DOT.format(a=b, b=b)}))"


def register(spark: SparkSession, vectors: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
    """Register the functions; tables that are None leave theirs out."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION content_id(data BINARY) RETURNS BINARY RETURN unhex(sha2(data, 256))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hex_id(data BINARY) RETURNS STRING RETURN lower(hex(data))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION zeroblob(n INT) RETURNS BINARY RETURN unhex(repeat('00', n))")
    # * and ? are wild, [..] and [^..] are sets, everything else is itself; case counts.
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION glob_match(pattern STRING, text STRING) RETURNS BOOLEAN
        RETURN rlike(text, concat(r'(?s)\A', replace(replace(regexp_replace(pattern, r'([.\\$|(){}+]|(?<!\[)\^)', r'\\$1'), '*', '.*'), '?', '.'), r'\z'))""")
    for metric in METRICS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vector_distance_{metric}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {distance_sql(metric, 'a', 'b')}")
    if vectors is not None:
        vectors.createOrReplaceTempView("stratalode_vectors")
        for metric in METRICS:
            name = f"vector_search_{metric}"
            spark.sql(f"""
                CREATE OR REPLACE TEMPORARY FUNCTION {name}(coll STRING, q ARRAY<FLOAT> DEFAULT NULL, src STRING DEFAULT NULL, k INT DEFAULT NULL, maxd DOUBLE DEFAULT NULL)
                RETURNS TABLE(rank BIGINT, vector_id STRING, distance DOUBLE)
                RETURN WITH d AS (
                  SELECT v.vector_id, CASE
                      WHEN ({name}.q IS NULL) = ({name}.src IS NULL) THEN raise_error('VectorInvalid: give a query or a source')
                      WHEN {name}.k IS NULL AND {name}.maxd IS NULL THEN raise_error('VectorInvalid: give k, a max_distance or both')
                      ELSE {distance_sql(metric, f'coalesce({name}.q, w.values)', 'v.values')} END AS distance
                  FROM stratalode_vectors v LEFT JOIN stratalode_vectors w ON w.collection_name = {name}.coll AND w.vector_id = {name}.src
                  WHERE v.collection_name = {name}.coll AND ({name}.src IS NULL OR v.vector_id <> {name}.src)),
                r AS (SELECT row_number() OVER (ORDER BY distance, vector_id) AS rank, vector_id, distance FROM d WHERE {name}.maxd IS NULL OR distance <= {name}.maxd)
                SELECT cast(rank AS BIGINT), vector_id, distance FROM r WHERE {name}.k IS NULL OR rank <= {name}.k""")
            missing = "raise_error('VectorNotFound')"
            find = "SELECT first(values) AS v, count(*) AS n FROM stratalode_vectors WHERE collection_name = {f}.coll AND vector_id = {f}.{id}"
            f = f"stored_distance_{metric}"
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}(coll STRING, id STRING, q ARRAY<FLOAT>) RETURNS DOUBLE RETURN SELECT CASE WHEN x.n = 0 THEN {missing} ELSE {distance_sql(metric, f'{f}.q', 'x.v')} END FROM ({find.format(f=f, id='id')}) x")
            f = f"stored_distance_by_id_{metric}"
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}(coll STRING, id STRING, src STRING) RETURNS DOUBLE RETURN SELECT CASE WHEN x.n = 0 OR y.n = 0 THEN {missing} ELSE {distance_sql(metric, 'y.v', 'x.v')} END FROM ({find.format(f=f, id='id')}) x, ({find.format(f=f, id='src')}) y")
    if nodes is not None and edges is not None:
        nodes.createOrReplaceTempView("stratalode_nodes")
        edges.createOrReplaceTempView("stratalode_edges")
        spark.sql("""
            CREATE OR REPLACE TEMPORARY FUNCTION graph_neighbors(graph STRING, node STRING, direction STRING DEFAULT 'outgoing', edge STRING DEFAULT NULL, k INT DEFAULT 10)
            RETURNS TABLE(rank BIGINT, node_id STRING, kind STRING, edge_type STRING)
            RETURN WITH e AS (
              SELECT CASE WHEN graph_neighbors.direction = 'outgoing' THEN to_node_id
                          WHEN graph_neighbors.direction = 'incoming' THEN from_node_id
                          ELSE raise_error('GraphInvalid: direction') END AS node_id, edge_type, created_order
              FROM stratalode_edges
              WHERE graph_name = graph_neighbors.graph
                AND CASE WHEN graph_neighbors.direction = 'outgoing' THEN from_node_id ELSE to_node_id END = graph_neighbors.node
                AND (graph_neighbors.edge IS NULL OR edge_type = graph_neighbors.edge)),
            r AS (SELECT row_number() OVER (ORDER BY e.created_order, e.node_id) AS rank, e.node_id, n.kind, e.edge_type
                  FROM e JOIN stratalode_nodes n ON n.graph_name = graph_neighbors.graph AND n.node_id = e.node_id)
            SELECT cast(rank AS BIGINT), node_id, kind, edge_type FROM r WHERE rank <= graph_neighbors.k""")


def with_walks(spark: SparkSession, text: str, nodes: DataFrame, edges: DataFrame, args: dict | list | None = None) -> DataFrame:
    """A statement in which ``graph_walk(graph, start, max_depth[, edge_type[, k]])`` stands for a walk's rows."""

    def view(call: re.Match) -> str:
        given = list(spark.sql(f"SELECT {call.group(1)}").first()) if call.group(1).strip() else []
        if not 3 <= len(given) <= 5 or any(x is None for x in given[:3]):
            raise E.GraphInvalid("graph_walk takes a graph, a start and a max_depth, then an edge type and a limit")
        name, start, depth, edge_type, k = [*given, *[None] * (5 - len(given))]
        found = f"stratalode_walk_{uuid.uuid4().hex}"
        graph.walk(nodes, edges, name, start, depth, edge_type, 10 if k is None else k).createOrReplaceTempView(found)
        return found

    return spark.sql(WALK.sub(view, text), args=args)
