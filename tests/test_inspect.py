import json

import pytest

from stratalode import errors as E
from stratalode.__main__ import main
from stratalode.functions.sql import register
from stratalode.sources.store import Store


@pytest.fixture
def store(spark, root):
    s = Store.create(spark, root)
    s.put_objects(spark.createDataFrame([(bytearray(f"object {i}".encode()),) for i in range(12)], "data binary"))
    s.create_graph()
    for n in "abc":
        s.put_graph_node(n, "k")
    s.put_graph_edge("a", "to", "b")
    s.put_graph_edge("b", "to", "c")
    return s


def run(spark, capsys, *args):
    code = main(list(args), spark)
    return code, json.loads(capsys.readouterr().out)


def test_cli(spark, store, capsys, tmp_path):
    code, out = run(spark, capsys, "objects", store.root, "--limit", "5")
    assert code == 0 and out["json_version"] == 1 and len(out["items"]) == 5 and out["truncated"]
    who = out["items"][0]["object_id"]
    code, out = run(spark, capsys, "object", store.root, who.upper())
    assert code == 0 and out["chunks"]["items"][0]["present"]
    chunk = out["chunks"]["items"][0]["chunk_hash"]
    assert run(spark, capsys, "chunk", store.root, chunk)[1]["objects"]["items"][0]["object_id"] == who
    assert run(spark, capsys, "object", store.root, "0" * 64)[0] == 3
    assert run(spark, capsys, "object", store.root, "xyz")[0] == 1
    assert run(spark, capsys, "info", store.root)[1]["objects"] == 12
    assert run(spark, capsys, "check", store.root, "--deep")[0] == 0
    walk = run(spark, capsys, "walk", store.root, "a", "--max-depth", "2", "--limit", "2")[1]
    assert [x["node_id"] for x in walk["items"]] == ["a", "b"] and walk["truncated"]
    assert run(spark, capsys, "backup", store.root, str(tmp_path / "c.strata"))[1]["chunks"] == 12
    assert run(spark, capsys, "info", str(tmp_path / "none.strata"))[0] == 3
    assert main(["nonsense"], spark) == 2
    store.put_graph_node("x", "k", target_type="object", target_ref="0" * 64)
    code, out = run(spark, capsys, "doctor", store.root)
    assert code == 4 and out["issues"][0]["kind"] == "node_object_target_missing" and out["suggestions"]


def test_listings(store):
    assert store.list_chunks(3)["truncated"] and len(store.list_graph_nodes(limit=200)["items"]) == 3
    assert [c["name"] for c in store.table_columns("graphs")] == ["name", "created_order"]
    with pytest.raises(E.VectorCollectionNotFound):
        store.list_vectors("none")


def test_stored_distances(spark):
    rows = spark.createDataFrame([("c", "a", [3.0, 4.0]), ("c", "b", [0.0, 0.0])], "collection_name string, vector_id string, values array<float>")
    register(spark, rows)
    assert spark.sql("SELECT stored_distance_l2('c', 'a', array(0f, 0f)) AS d").first().d == 5.0
    assert spark.sql("SELECT stored_distance_by_id_l2('c', 'a', 'b') AS d").first().d == 5.0
    with pytest.raises(Exception, match="VectorNotFound"):
        spark.sql("SELECT stored_distance_l2('c', 'zz', array(0f, 0f)) AS d").collect()
