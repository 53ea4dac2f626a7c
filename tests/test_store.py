import random

import pytest
from pyspark.sql import functions as F

from stratalode import errors as E
from stratalode import schemas
from stratalode.functions import scalars
from stratalode.sources.store import Store, convert, restore
from stratalode.streaming.hub import CAPACITY, Hub, queue_rows


def test_open_and_create(spark, root):
    with pytest.raises(E.NotStorePath):
        Store.create(spark, root + "x")
    with pytest.raises(E.NotStore):
        Store.open(spark, root)
    Store.create(spark, root)
    with pytest.raises(E.DestinationExists):
        Store.create(spark, root)
    store = Store.open(spark, root, read_only=True)
    with pytest.raises(E.ReadOnly):
        store.create_graph()
    store.close()
    with pytest.raises(E.ClosedHandle):
        store.table("objects")


def test_objects(spark, root):
    store = Store.create(spark, root)
    data = random.Random(1).randbytes(50_000)
    who = store.put_object(data)
    assert who == scalars.object_id(data) and store.put_object(data) == who
    assert store.get_object(who) == data and store.object_size(who) == len(data)
    assert store.read_object_range(who, 9_000, 20_000) == data[9_000:29_000]
    assert store.read_object_range(who, len(data), 5) == b""
    with pytest.raises(E.ObjectRangeInvalid):
        store.read_object_range(who, len(data) + 1, 1)
    manifest = store.object_manifest(who)
    assert [c["index"] for c in manifest] == list(range(store.object_chunk_count(who)))
    empty = store.put_object(b"")
    assert store.get_object(empty) == b"" and store.object_chunk_count(empty) == 0
    loose = b"loose bytes"
    with pytest.raises(E.ObjectChunkHashMismatch):
        store.put_object_chunk(b"\0" * 32, loose)
    store.put_object_chunk(scalars.object_id(loose), loose)
    assert not store.delete_object_chunk(manifest[0]["hash"])
    with pytest.raises(E.ObjectAlreadyExists):
        store.assemble_object(who, len(data), list(reversed(manifest)))
    with pytest.raises(E.ObjectManifestInvalid):
        store.assemble_object(who, len(data) + 1, manifest)
    store.assemble_object(scalars.object_id(loose), len(loose), [{"index": 0, "hash": scalars.object_id(loose), "offset": 0, "size_bytes": len(loose)}])
    assert store.get_object(scalars.object_id(loose)) == loose
    store.delete_object(who)
    assert not store.has_object(who) and not store.has_object_chunk(manifest[0]["hash"]) and store.has_object(empty)
    with pytest.raises(E.ObjectNotFound):
        store.get_object(who)
    store.begin()
    with pytest.raises(E.ObjectTransactionActive):
        store.put_object(b"x")
    store.rollback()


def test_object_writer(spark, root):
    store = Store.create(spark, root)
    data = random.Random(2).randbytes(200_000)
    writer = store.object_writer()
    for i in range(0, len(data), 7_777):
        writer.write(data[i : i + 7_777])
    who = writer.finish()
    assert store.get_object(who) == data
    with pytest.raises(E.ObjectWriterClosed):
        writer.write(b"x")
    before = store.table("chunks").count()
    writer = store.object_writer()
    writer.write(random.Random(3).randbytes(100_000))
    writer._flush()
    writer.cancel()
    assert store.table("chunks").count() == before
    rest = spark.createDataFrame([(bytearray(data[:9]),), (bytearray(data[:9]),), (None,)], "data binary")
    store.put_objects(rest)
    assert store.summary()["objects"] == 2 and store.object_stats()["loose_chunk_count"] == 0


def test_vectors(spark, root):
    store = Store.create(spark, root)
    store.create_vector_collection("c", 2, "l2")
    with pytest.raises(E.VectorCollectionExists):
        store.create_vector_collection("c", 3, "dot")
    store.put_vectors("c", [("a", [0, 0]), ("b", [9, 9]), ("b", [3, 4])])
    assert store.get_vector("c", "b") == [3.0, 4.0]
    with pytest.raises(E.VectorDimensionMismatch):
        store.put_vectors("c", [("d", [1, 1]), ("e", [1])])
    assert not store.has_vector("c", "d")
    assert store.vector_collection_info("c")["vector_count"] == 2
    assert [r.vector_id for r in store.search_vectors("c", source_id="a").collect()] == ["b"]
    with pytest.raises(E.VectorCollectionNotFound):
        store.search_vectors("x", [0, 0])
    with pytest.raises(E.VectorInvalid):
        store.search_vectors("c")
    store.delete_vector("c", "a")
    with pytest.raises(E.VectorNotFound):
        store.delete_vector("c", "a")
    store.delete_vector_collection("c")
    assert store.list_vector_collections().count() == 0


def test_graph(spark, root):
    store = Store.create(spark, root)
    store.create_graph()
    for n, kind in (("message:1", "message"), ("message:2", "message"), ("attachment:1", "attachment"), ("entity:z", "entity")):
        store.put_graph_node(n, kind)
    for t, n in (("replies_to", "message:2"), ("has_attachment", "attachment:1"), ("mentions", "entity:z")):
        store.put_graph_edge("message:1", t, n)
    store.put_graph_edge("message:1", "mentions", "entity:z")
    assert [(r.node_id, r.edge_type) for r in store.graph_neighbors("message:1").orderBy("rank").collect()] == [("message:2", "replies_to"), ("attachment:1", "has_attachment"), ("entity:z", "mentions")]
    assert [(r.node_id, r.depth, r.predecessor_node_id) for r in store.graph_walk("message:1").orderBy("rank").collect()][:2] == [("message:1", 0, None), ("message:2", 1, "message:1")]
    assert store.graph_info() == {"name": "default", "node_count": 4, "edge_count": 3}
    order = store.get_graph_node("message:2")["created_order"]
    store.put_graph_node("message:2", "note", target_type="vector", target_namespace="c", target_ref="v")
    assert store.get_graph_node("message:2")["created_order"] == order
    assert [i["kind"] for i in store.check()["issues"]] == ["node_vector_target_missing"]
    with pytest.raises(E.GraphNodeNotFound):
        store.put_graph_edge("message:1", "x", "nobody")
    store.delete_graph_node("message:2")
    assert store.graph_info()["edge_count"] == 2 and store.check()["ok"]
    with pytest.raises(E.GraphEdgeNotFound):
        store.delete_graph_edge("message:1", "replies_to", "message:2")
    store.delete_graph()
    assert store.list_graphs().count() == 0


def test_transactions_and_busy(spark, root):
    store = Store.create(spark, root)
    news = store.listen("news")
    with store.transaction():
        store.create_graph("a")
        store.notify("news", "one")
        assert news.try_receive() is None
        with pytest.raises(ZeroDivisionError), store.with_savepoint("s"):
            store.create_graph("b")
            store.notify("news", "lost")
            1 / 0
        store.notify("news", "two")
    assert [news.try_receive().payload for _ in range(2)] == ["one", "two"] and news.try_receive() is None
    assert Store.open(spark, root).has_graph("a") and not store.has_graph("b")
    with pytest.raises(ValueError), store.transaction():
        store.create_graph("c")
        raise ValueError
    assert not store.has_graph("c")
    other = Store.open(spark, root)
    other.create_graph("mine")
    with pytest.raises(E.Busy):
        store.create_graph("late")
    assert not store.has_graph("late")


def test_records(spark, root):
    store = convert(spark, {"t": spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")}, root)
    with pytest.raises(E.NameConflict):
        convert(spark, {"_stratalode_x": spark.range(1)}, root.replace("a.strata", "b.strata"))
    more = spark.createDataFrame([(2, "B"), (3, "c")], "id int, name string")
    with pytest.raises(E.Constraint):
        store.insert("t", more, ["id"])
    assert store.insert("t", more, ["id"], "ignore") == 1
    store.insert("t", more, ["id"], "update")
    assert store.update("t", "id = 1", {"name": "upper(name)"}) == 1
    assert store.delete_rows("t", "id = 3") == 1 and store.total_changes == 5
    assert [tuple(r) for r in store.sql("SELECT * FROM t WHERE id >= :low ORDER BY id", {"low": 1}).collect()] == [(1, "A"), (2, "B")]


def test_copies_bound_stores_and_salvage(spark, root, tmp_path):
    store = Store.create(spark, root)
    data = random.Random(5).randbytes(30_000)
    who, keep = store.put_object(data), store.put_object(b"keep")
    store.create_vector_collection("c", 2, "cosine")
    store.put_vector("c", "v", [1, 0])
    with pytest.raises(E.BoundStoreExists):
        store.bind_store("object", str(tmp_path / "o.strata"))
    assert store.split_store("object", str(tmp_path / "o.strata"))["objects"] == 2
    assert store.get_object(who) == data and store.bound["object"].table("objects").count() == 2
    again = Store.open(spark, root)
    assert again.get_object(who) == data
    again.put_object(b"more")
    with pytest.raises(E.Busy):
        store.put_object(b"late")
    copy = again.backup(str(tmp_path / "copy.strata"))
    assert copy.get_object(who) == data and not copy.bound
    with pytest.raises(E.DestinationExists):
        again.backup(str(tmp_path / "copy.strata"))
    assert restore(spark, copy.root, str(tmp_path / "r.strata")).get_vector("c", "v") == [1.0, 0.0]
    assert copy.compact(str(tmp_path / "small.strata")).summary()["objects"] == 3
    copy.vacuum()
    assert Store.open(spark, copy.root).get_object(who) == data
    # Damage a chunk and a vector.
    target = copy.object_manifest(who)[0]["hash"]
    bad = F.when(F.col("chunk_hash") == F.lit(bytearray(target)), F.lit(bytearray(b"x"))).otherwise(F.col("data"))
    copy._change({"chunks": ("replace", copy.table("chunks").withColumn("data", bad)), "vectors": ("append", spark.createDataFrame([("c", "zero", 2, [0.0, 0.0])], schemas.VECTORS))})
    with pytest.raises(E.ObjectCorrupt):
        copy.get_object(who)
    assert {i["kind"] for i in copy.check(deep=True)["issues"]} == {"chunk_integrity", "object_integrity", "vector_integrity"}
    plan = copy.salvage_plan()
    assert plan["recoverability"] == "partially_recoverable" and plan["recoverable"]["objects"] == 2
    saved = copy.salvage(str(tmp_path / "saved.strata"))
    assert saved.check(deep=True)["ok"] and saved.get_object(keep) == b"keep" and not saved.has_object(who)
    again.unbind_store("object")
    assert not Store.open(spark, root).has_object(who)


def test_hub_overflow_and_scopes(spark):
    hub = Hub()
    sub = hub.listen("c")
    for i in range(CAPACITY + 5):
        hub.notify("c", str(i))
    first = sub.try_receive()
    assert (first.payload, first.dropped_before) == ("5", 5) and sub.try_receive().dropped_before == 0
    hub.begin()
    hub.notify("c", "gone")
    hub.rollback()
    assert hub.notify("c", "next") == CAPACITY + 7
    items = spark.createDataFrame([("c", i, "p") for i in range(9)], "channel string, sequence long, payload string")
    got = queue_rows(items, 4).orderBy("sequence").collect()
    assert [(r.sequence, r.dropped_before) for r in got] == [(5, 5), (6, 0), (7, 0), (8, 0)]
    sub.close()
    with pytest.raises(E.ClosedHandle):
        sub.try_receive()


def test_feed(spark, tmp_path):
    from stratalode.streaming import feed

    at = str(tmp_path / "log")
    feed.append(spark, at, [(1, "a", "x"), (2, "b", "y")])
    query = feed.stream(spark, at, "a").writeStream.format("memory").queryName("feed_out").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [r.payload for r in spark.table("feed_out").collect()] == ["x"]


def test_parts_of_one_owner(spark, root):
    store = Store.create(spark, root)
    for name in ("a", "b"):
        store.create_vector_collection(name, 2, "l2")
        store.put_vectors(name, [("x", [1, 1]), ("y", [2, 2])])
    of_a = [p for p in store.manifest["tables"]["vectors"] if p.endswith(store._mark("a"))]
    store.put_vector("b", "x", [5, 5])  # rewrites the parts of b only
    assert [p for p in store.manifest["tables"]["vectors"] if p.endswith(store._mark("a"))] == of_a
    assert store.get_vector("b", "x") == [5.0, 5.0] and store.get_vector("a", "x") == [1.0, 1.0]
    # A part of several owners keeps the rows of the others.
    store._change({"vectors": ("replace", store.table("vectors"))})
    store.delete_vector("a", "x")
    assert store.table("vectors").count() == 3 and store.get_vector("b", "y") == [2.0, 2.0]
    store.put_vector("a", "z", [0, 0])
    store.vacuum()
    again = Store.open(spark, root)
    assert sorted((r.collection_name, r.vector_id) for r in again.table("vectors").collect()) == [("a", "y"), ("a", "z"), ("b", "x"), ("b", "y")]
    again.delete_vector_collection("b")
    assert again.table("vectors").count() == 2


def test_an_update_rewrites_only_the_files_it_touches(spark, root):
    store = Store.create(spark, root)
    store.create_vector_collection("c", 2, "l2")
    for i in range(3):
        store.put_vectors("c", [(f"{i}-{k}", [i, k]) for k in range(4)])
    before = store.manifest["tables"]["vectors"]
    store.delete_vector("c", "1-2")
    store.put_vector("c", "1-3", [7, 7])
    after = store.manifest["tables"]["vectors"]
    untouched = [p for p in before if p in after]
    assert len(untouched) >= 2  # the other two puts
    assert {r.vector_id for r in store.table("vectors").collect()} == {f"{i}-{k}" for i in range(3) for k in range(4)} - {"1-2"}
    assert store.get_vector("c", "1-3") == [7, 7] and Store.open(spark, root).vector_collection_info("c")["vector_count"] == 11
    store.vacuum()
    assert Store.open(spark, root).vector_collection_info("c")["vector_count"] == 11


def test_a_commit_that_was_cut_off_leaves_the_store_as_it_was(spark, root, tmp_path):
    store = Store.create(spark, root)
    store.create_vector_collection("c", 2, "l2")
    store.put_vectors("c", [("a", [1, 2])])
    store.split_store("vector", str(tmp_path / "v.strata"))
    create = store.files.create
    store.files.create = lambda path, text: False if path.startswith(root) else create(path, text)  # the bound manifest is written, the main one is not
    with pytest.raises(E.Busy):
        store.put_vectors("c", [("b", [3, 4])])
    again = Store.open(spark, root)
    assert not again.has_vector("c", "b") and again.get_vector("c", "a") == [1, 2]
    again.put_vectors("c", [("d", [5, 6])])
    assert {r.vector_id for r in Store.open(spark, root).table("vectors").collect()} == {"a", "d"}


def test_bulk_graph_rows_are_checked(spark, root):
    store = Store.create(spark, root)
    store.create_graph("g")
    node = lambda *ids: spark.createDataFrame([("g", i, "k", "none", None, None, n) for n, i in enumerate(ids)], schemas.GRAPH_NODES)
    edge = lambda *ends: spark.createDataFrame([("g", a, "t", b, n) for n, (a, b) in enumerate(ends)], schemas.GRAPH_EDGES)
    store.put_graph_rows(node("a", "b"), edge(("a", "b")), "g")
    for nodes, edges, wrong in ((node("a"), edge(), E.Constraint), (node("c", "c"), edge(), E.Constraint), (node("c"), edge(("a", "b")), E.Constraint), (node("c"), edge(("c", "x")), E.GraphNodeNotFound), (node("c").withColumn("graph_name", F.lit("h")), edge(), E.GraphNotFound)):
        with pytest.raises(wrong):
            store.put_graph_rows(nodes, edges)
    store.put_graph_rows(node("c"), edge(("b", "c")))
    assert store.graph_info("g") == {"name": "g", "node_count": 3, "edge_count": 2}


def test_run_tries_again_after_another_writer(spark, root):
    first = Store.create(spark, root)
    first.put_table("t", spark.range(10))
    second = Store.open(spark, root)
    first.delete_rows("t", "id = 1")
    with pytest.raises(E.Busy):
        second.delete_rows("t", "id = 2")
    with pytest.raises(E.Busy):
        Store.open(spark, root).run(lambda s: (_ for _ in ()).throw(E.Busy("always")))
    second.run(lambda s: s.delete_rows("t", "id = 2"), busy_timeout=2.0)
    assert Store.open(spark, root).table("t").count() == 8


def test_sql_notify_and_walk(spark, root):
    store = Store.create(spark, root)
    inbox = store.listen("c")
    with pytest.raises(E.StoreError):
        store.sql("SELECT notify('', 'x')")
    assert [r[0] for r in store.sql("SELECT notify('c', 'it''s') ").collect()] == [1]
    assert inbox.try_receive().payload == "it's"
    store.create_graph("g")
    store.put_graph_node("it's", "k", "g")
    store.put_graph_node("b", "k", "g")
    store.put_graph_edge("it's", "t", "b", "g")
    assert [r.node_id for r in store.sql("SELECT w.node_id FROM graph_walk('g', 'it''s', 1) w ORDER BY rank").collect()] == ["it's", "b"]
    for text in ("SELECT * FROM graph_walk('g', 'b')", "SELECT * FROM graph_walk('g', NULL, 1)"):
        with pytest.raises(E.GraphInvalid):
            store.sql(text)
