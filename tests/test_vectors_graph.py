import math
import random

import pytest

from stratalode import errors as E
from stratalode.functions.sql import register
from stratalode.operators import graph as G
from stratalode.operators import vectors as V


def rows(spark, data):
    return spark.createDataFrame([("c", k, list(map(float, v))) for k, v in data.items()], "collection_name string, vector_id string, values array<float>")


def ids(df):
    return [(r.vector_id, r.distance) for r in df.orderBy("rank").collect()]


def test_golden_distances(spark):
    got = ids(V.search(rows(spark, {"east": (1, 0), "north": (0, 1), "northeast": (1, 1)}), [1, 0], "cosine", 3))
    assert [k for k, _ in got] == ["east", "northeast", "north"]
    assert got[0][1] == 0 and abs(got[1][1] - (1 - math.sqrt(0.5))) < 1e-12 and got[2][1] == 1
    got = ids(V.search(rows(spark, {"near": (1, 1), "far": (4, 5), "tie-a": (1, 3), "tie-b": (3, 1), "other": (0, 0)}), [2, 2], "l2", 3))
    assert got == [("near", math.sqrt(2)), ("tie-a", math.sqrt(2)), ("tie-b", math.sqrt(2))]
    assert ids(V.search(rows(spark, {"large": (3, 0), "small": (1, 0), "negative": (-1, 0)}), [1, 0], "dot", 9)) == [("large", -3), ("small", -1), ("negative", 1)]


def test_candidates_thresholds_and_sources(spark):
    data = rows(spark, {"global-nearest": (0, 0), "near": (1, 0), "tie-b": (0, 2), "tie-a": (2, 0), "far": (10, 0)})
    some = spark.createDataFrame([("near",), ("tie-a",), ("tie-b",), ("near",), ("missing",)], "id string")
    assert ids(V.search(data, [0, 0], "l2", 3, candidates=some)) == [("near", 1), ("tie-a", 2), ("tie-b", 2)]
    line = rows(spark, {"source": (0, 0), "one": (1, 0), "two": (2, 0), "three": (3, 0)})
    assert [k for k, _ in ids(V.search(line, [0, 0], "l2", None, 2.0))] == ["source", "one", "two"]
    assert [k for k, _ in ids(V.search_by_id(line, "source", "l2", limit=2))] == ["one", "two"]
    assert ids(V.search(line, [0, 0], "l2", 0)) == []
    with pytest.raises(E.VectorNotFound):
        V.search_by_id(line, "nobody", "l2", limit=2)
    with pytest.raises(E.VectorInvalid):
        V.search(line, [0, 0], "l2", None)


@pytest.mark.parametrize("bad", [[1.0], [float("nan"), 1.0], None, [0.0, 0.0]])
def test_damaged_row_fails_the_search(spark, bad):
    data = rows(spark, {"a": (1, 0)}).unionByName(spark.createDataFrame([("c", "bad", bad)], "collection_name string, vector_id string, values array<float>"))
    with pytest.raises(Exception, match="VectorCorrupt"):
        V.search(data, [1, 0], "cosine", 1).collect()


def test_many_queries(spark):
    rng = random.Random(1)
    data = {f"v{i}": (rng.random(), rng.random(), rng.random()) for i in range(60)}
    queries = spark.createDataFrame([(i, [rng.random() for _ in range(3)]) for i in range(7)], "query_id int, values array<float>")
    got = V.search_many(rows(spark, data), queries, "l2", 4, block=3).collect()
    for q in queries.collect():
        alone = ids(V.search(rows(spark, data), list(q["values"]), "l2", 4))
        assert [(r.vector_id, r.distance) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q.query_id] == alone


def test_sql_functions(spark):
    data = rows(spark, {"chunk-a": (1, 0), "chunk-b": (3, 0), "chunk-c": (10, 0)})
    register(spark, data)
    got = spark.sql("SELECT * FROM vector_search_l2('c', array(0f, 0f), k => 2) ORDER BY rank").collect()
    assert [(r.rank, r.vector_id, r.distance) for r in got] == [(1, "chunk-a", 1.0), (2, "chunk-b", 3.0)]
    assert spark.sql("SELECT s.vector_id FROM (SELECT 'chunk-c' AS src) o, LATERAL vector_search_l2('c', src => o.src, maxd => 8.0D) s").collect()[0][0] == "chunk-b"
    with pytest.raises(Exception, match="VectorInvalid"):
        spark.sql("SELECT * FROM vector_search_l2('c', array(0f, 0f), 'chunk-a', k => 2)").collect()
    with pytest.raises(Exception, match="VectorInvalid"):
        spark.sql("SELECT * FROM vector_search_l2('c', array(0f, 0f))").collect()


def sequential(nodes, edges, start, depth, limit):
    """The walk by its definition: a queue of nodes."""
    seen, queue, out, at = {start}, [(start, 0, None, None)], [], 0
    while at < len(queue) and len(out) < limit:
        node, d, before, kind = queue[at]
        out.append((node, d, before, kind))
        at += 1
        if d >= depth:
            continue
        near = sorted((e for e in edges if e[1] == node), key=lambda e: (e[4], e[3]))[:limit]
        for e in near:
            if e[3] not in seen:
                seen.add(e[3])
                queue.append((e[3], d + 1, node, e[2]))
    return out


def test_walks(spark):
    nodes_schema = "graph_name string, node_id string, kind string"
    edges_schema = "graph_name string, from_node_id string, edge_type string, to_node_id string, created_order long"
    rng = random.Random(9)
    for _ in range(4):
        names = [f"n{i}" for i in range(7)]
        made = list({(rng.choice(names), rng.choice("xy"), rng.choice(names)) for _ in range(14)})
        rng.shuffle(made)
        edges = [("g", a, t, b, i) for i, (a, t, b) in enumerate(made)]
        nodes = spark.createDataFrame([("g", n, "k") for n in names], nodes_schema)
        depth, limit = rng.randrange(0, 4), rng.randrange(1, 6)
        got = G.walk(nodes, spark.createDataFrame(edges, edges_schema), "g", "n0", depth, None, limit).orderBy("rank").collect()
        assert [(r.node_id, r.depth, r.predecessor_node_id, r.edge_type) for r in got] == sequential(names, edges, "n0", depth, limit)
    loop = spark.createDataFrame([("g", "a", "x", "a", 1), ("g", "a", "y", "a", 2), ("g", "a", "x", "b", 3)], edges_schema)
    two = spark.createDataFrame([("g", "a", "k"), ("g", "b", "k")], nodes_schema)
    assert [r.node_id for r in G.walk(two, loop, "g", "a", 1, None, 2).collect()] == ["a"]
    assert [r.node_id for r in G.walk(two, loop, "g", "a", 1, None, 3).collect()] == ["a", "b"]
    assert G.walk(two, loop, "g", "a", 1, None, 0).collect() == []
    with pytest.raises(E.GraphNodeNotFound):
        G.walk(two, loop, "g", "c")


def test_fan_out(spark):
    nodes = spark.createDataFrame([("g", "center", "c"), *[("g", f"leaf:{i}", "l") for i in range(150)]], "graph_name string, node_id string, kind string")
    edges = spark.createDataFrame([("g", "center", "to", f"leaf:{i}", i) for i in range(150)], "graph_name string, from_node_id string, edge_type string, to_node_id string, created_order long")
    assert [r.node_id for r in G.neighbors(nodes, edges, "g", "center", limit=25).orderBy("rank").collect()] == [f"leaf:{i}" for i in range(25)]
    walk = G.walk(nodes, edges, "g", "center", limit=30).orderBy("rank").collect()
    assert [r.node_id for r in walk] == ["center", *[f"leaf:{i}" for i in range(29)]]


def test_bulk_edges_are_numbered_inside_their_graph(spark):
    schema = "graph_name string, from_node_id string, edge_type string, to_node_id string, created_order long"
    old = spark.createDataFrame([("g", "a", "t", "b", 7), ("h", "a", "t", "b", 2)], schema)
    new = spark.createDataFrame([("g", "a", "t", "b"), ("g", "b", "t", "a"), ("g", "b", "t", "a"), ("h", "c", "t", "d"), ("i", "c", "t", "d")], "graph_name string, from_node_id string, edge_type string, to_node_id string")
    got = {(r.graph_name, r.from_node_id): r.created_order for r in G.add_edges(None, old, new).collect()}
    assert got == {("g", "a"): 7, ("g", "b"): 8, ("h", "a"): 2, ("h", "c"): 3, ("i", "c"): 1}
