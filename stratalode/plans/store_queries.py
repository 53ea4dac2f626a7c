"""Queries that build a store from the driver tables, act on it through its calls, and return what SQL can state.

Each call makes its own store in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.functions.scalars import hex_id, object_id
from stratalode.functions.sql import register
from stratalode.plans import tables
from stratalode.session import scratch, table
from stratalode.sources.store import SUFFIX, Store, convert, numbered, restore
from stratalode.streaming import feed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _path(spark: SparkSession) -> str:
    return scratch(spark, "store") + SUFFIX


def _new(spark: SparkSession) -> Store:
    return Store.create(spark, _path(spark))


# Vectors


def _vectors(spark: SparkSession, sf_dir: str) -> Store:
    store = _new(spark)
    store.create_vector_collection("emb", 64, "l2")
    store.create_vector_collection("void", 8, "cosine")
    store.put_vector_rows("emb", tables.vectors(spark, sf_dir))
    return store


def _found(store: Store) -> DataFrame:
    """Every stored vector by its ends."""
    return store.table("vectors").select("collection_name", "vector_id", F.col("values")[0].cast("double").alias("first"), F.col("values")[63].cast("double").alias("last"))


VECTOR_ENDS = "'emb' AS collection_name, vec_id::VARCHAR AS vector_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last"


@_add("store_vector_collections", "SELECT 'emb' AS name, 64 AS dimensions, 'l2' AS metric, count(*) AS vector_count, count(*) * 256 AS value_bytes FROM embeddings UNION ALL SELECT 'void', 8, 'cosine', 0, 0")
def _collections(spark, sf_dir):
    return _vectors(spark, sf_dir).list_vector_collections()


@_add("store_vector_upsert", "SELECT 'emb' AS collection_name, vec_id::VARCHAR AS vector_id, (CASE WHEN label = 1 THEN 2 ELSE 1 END * embedding[1])::DOUBLE AS first, (CASE WHEN label = 1 THEN 2 ELSE 1 END * embedding[64])::DOUBLE AS last FROM embeddings")
def _upsert(spark, sf_dir):
    store = _vectors(spark, sf_dir)
    twice = F.transform("values", lambda x: x * 2)
    store.put_vector_rows("emb", tables.vectors(spark, sf_dir).filter("label = 1").withColumn("values", twice))
    return _found(store)


@_add("store_vector_put_get", "SELECT i AS place, (embedding[i] + 1)::DOUBLE AS value FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings WHERE vec_id = 7)")
def _put_get(spark, sf_dir):
    store = _vectors(spark, sf_dir)
    store.put_vector("emb", "7", [x + 1 for x in store.get_vector("emb", "7")])
    return spark.createDataFrame([(i, x) for i, x in enumerate(store.get_vector("emb", "7"), 1)], "place long, value float").withColumn("value", F.col("value").cast("double"))


@_add("store_vector_delete", f"SELECT {VECTOR_ENDS} FROM embeddings WHERE vec_id <> 7")
def _delete_vector(spark, sf_dir):
    store = _vectors(spark, sf_dir)
    assert store.has_vector("emb", "7")
    store.delete_vector("emb", "7")
    assert not store.has_vector("emb", "7")
    return _found(store)


@_add("store_vector_drop", "SELECT 'void' AS name, 0 AS vector_count, 0 AS left_over")
def _drop(spark, sf_dir):
    store = _vectors(spark, sf_dir)
    store.delete_vector_collection("emb")
    return store.list_vector_collections().select("name", "vector_count", F.lit(store.table("vectors").count()).alias("left_over"))


# Graphs


def _graph(spark: SparkSession, sf_dir: str) -> Store:
    store = _new(spark)
    store.create_graph(tables.GRAPH)
    store.create_graph("void")
    store.put_graph_rows(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), tables.GRAPH)
    return store


CTE = f"WITH {tables.GRAPH_CTE}"
LISTED = "SELECT 'star' AS name, (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count UNION ALL SELECT 'void', 0, 0"


@_add("graph_list", f"{CTE} {LISTED}")
def _list(spark, sf_dir):
    return _graph(spark, sf_dir).list_graphs().select("name", "node_count", "edge_count")


@_add("store_graph_drop", "SELECT 'void' AS name, 0 AS node_count, 0 AS edge_count")
def _drop_graph(spark, sf_dir):
    store = _graph(spark, sf_dir)
    store.delete_graph(tables.GRAPH)
    assert not store.has_graph(tables.GRAPH)
    return store.list_graphs().select("name", "node_count", "edge_count")


@_add("store_graph_put_node", f"{CTE} SELECT CASE WHEN node_id = 'nation:3' THEN 'country' ELSE kind END AS kind, count(*) AS n FROM (SELECT node_id, kind FROM n UNION ALL SELECT 'note:1', 'note') GROUP BY 1")
def _put_node(spark, sf_dir):
    store = _graph(spark, sf_dir)
    store.put_graph_node("note:1", "note", tables.GRAPH)
    store.put_graph_node("nation:3", "country", tables.GRAPH)
    return store.table("graph_nodes").groupBy("kind").agg(F.count("*").alias("n"))


@_add("store_graph_get_node", "SELECT 'nation:' || n_nationkey AS node_id, 'nation' AS kind, 'record' AS target_type, 'nation' AS target_namespace, n_nationkey::VARCHAR AS target_ref FROM nation WHERE n_nationkey = 3")
def _get_node(spark, sf_dir):
    store = _graph(spark, sf_dir)
    found = store.get_graph_node("nation:3", tables.GRAPH)
    names = ["node_id", "kind", "target_type", "target_namespace", "target_ref"]
    return spark.createDataFrame([tuple(found[c] for c in names)], ", ".join(f"{c} string" for c in names))


@_add("store_graph_delete_node", f"{CTE} SELECT from_node_id, edge_type, to_node_id FROM e WHERE edge_type <> 'contains' AND from_node_id <> 'nation:3' AND to_node_id <> 'nation:3'")
def _delete_node(spark, sf_dir):
    store = _graph(spark, sf_dir)
    store.delete_graph_node("nation:3", tables.GRAPH)
    assert not store.has_graph_node("nation:3", tables.GRAPH)
    return store.table("graph_edges").filter("edge_type <> 'contains'").select("from_node_id", "edge_type", "to_node_id")


@_add(
    "store_graph_edges",
    f"{CTE}, d AS (SELECT from_node_id AS f FROM e WHERE to_node_id = 'nation:3' AND edge_type = 'has_nation') "
    "SELECT edge_type, count(*) AS n, max(created_order) AS last FROM (SELECT edge_type, created_order FROM e WHERE NOT (to_node_id = 'nation:3' AND edge_type = 'has_nation') "
    "UNION ALL SELECT 'beside', max(created_order) + 1 FROM e) GROUP BY edge_type",
)
def _edges(spark, sf_dir):
    store = _graph(spark, sf_dir)
    for _ in range(2):  # the second call changes nothing
        store.put_graph_edge("nation:3", "beside", "nation:4", tables.GRAPH)
    assert store.get_graph_edge("nation:3", "beside", "nation:4", tables.GRAPH)["edge_type"] == "beside"
    region = store.graph_neighbors("nation:3", tables.GRAPH, "incoming", "has_nation").first().node_id
    store.delete_graph_edge(region, "has_nation", "nation:3", tables.GRAPH)
    assert not store.has_graph_edge(region, "has_nation", "nation:3", tables.GRAPH)
    return store.table("graph_edges").groupBy("edge_type").agg(F.count("*").alias("n"), F.max("created_order").alias("last"))


# Objects


def _objects(spark: SparkSession, sf_dir: str) -> Store:
    store = _new(spark)
    store.put_objects(tables.blobs(spark, sf_dir))
    return store


def _text(spark: SparkSession, sf_dir: str, doc_id: int = 0) -> bytes:
    return table(spark, sf_dir, "documents").filter(F.col("doc_id") == doc_id).first().text.encode()


@_add("store_objects", "SELECT DISTINCT sha256(text) AS object_id, octet_length(encode(text)) AS size_bytes FROM documents")
def _put_objects(spark, sf_dir):
    return _objects(spark, sf_dir).table("objects").select(hex_id(F.col("object_id")).alias("object_id"), "size_bytes")


@_add("store_object_get", "SELECT text, octet_length(encode(text)) AS size_bytes, substr(hex(encode(text)), 21, 200) AS range, true AS has FROM documents WHERE doc_id = 0")
def _get_object(spark, sf_dir):
    store, who = _objects(spark, sf_dir), object_id(_text(spark, sf_dir))
    row = (store.get_object(who).decode(), store.object_size(who), store.read_object_range(who, 10, 100).hex().upper(), store.has_object(who))
    return spark.createDataFrame([row], "text string, size_bytes long, range string, has boolean")


@_add("store_object_manifest", "SELECT sum(size_bytes)::BIGINT AS size_bytes, true AS contiguous, true AS chunks_sound FROM (SELECT octet_length(encode(text)) AS size_bytes FROM documents WHERE doc_id = 0)")
def _object_manifest(spark, sf_dir):
    store, who = _objects(spark, sf_dir), object_id(_text(spark, sf_dir))
    rows = store.object_manifest(who)
    ends = [r["offset"] + r["size_bytes"] for r in rows]
    sound = all(object_id(store.get_object_chunk(r["hash"])) == r["hash"] for r in rows)
    row = (sum(r["size_bytes"] for r in rows), [r["offset"] for r in rows] == [0, *ends[:-1]] and len(rows) == store.object_chunk_count(who), sound)
    return spark.createDataFrame([row], "size_bytes long, contiguous boolean, chunks_sound boolean")


@_add("store_object_delete", "SELECT DISTINCT sha256(text) AS object_id FROM documents WHERE text <> (SELECT text FROM documents WHERE doc_id = 0)")
def _delete_object(spark, sf_dir):
    store, who = _objects(spark, sf_dir), object_id(_text(spark, sf_dir))
    store.delete_object(who)
    assert not store.has_object(who) and not store.issues().count()
    return store.table("objects").select(hex_id(F.col("object_id")).alias("object_id"))


@_add("store_chunks", "SELECT sha256(text) AS chunk_hash, text AS data, true AS loose_deleted, false AS left_over FROM documents WHERE doc_id = 0")
def _chunks(spark, sf_dir):
    data = _text(spark, sf_dir)
    store, who = _new(spark), object_id(data)
    assert len(data) <= 65536
    store.put_object_chunk(who, data)
    read = store.get_object_chunk(who).decode()
    row = (who.hex(), read, store.delete_object_chunk(who), store.has_object_chunk(who))
    return spark.createDataFrame([row], "chunk_hash string, data string, loose_deleted boolean, left_over boolean")


def _pieces(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


@_add("store_object_assemble", "SELECT sha256(text) AS object_id, text, ceil(octet_length(encode(text)) / 1000.0)::BIGINT AS chunk_count FROM documents WHERE doc_id = 0")
def _assemble(spark, sf_dir):
    data = _text(spark, sf_dir)
    store, who = _new(spark), object_id(data)
    chunks = []
    for i, part in enumerate(_pieces(data, 1000)):
        store.put_object_chunk(object_id(part), part)
        chunks.append({"index": i, "hash": object_id(part), "offset": 1000 * i, "size_bytes": len(part)})
    store.assemble_object(who, len(data), chunks[::-1])
    return spark.createDataFrame([(who.hex(), store.get_object(who).decode(), store.object_chunk_count(who))], "object_id string, text string, chunk_count long")


@_add("store_object_writer", "SELECT sha256(string_agg(text, '' ORDER BY conv_id, turn)) AS object_id, sum(octet_length(encode(text)))::BIGINT AS size_bytes, 0::BIGINT AS left_by_cancelled FROM conversations")
def _writer(spark, sf_dir):
    store = _new(spark)
    texts = [r.text.encode() for r in table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").select("text").toLocalIterator()]
    cancelled = store.object_writer()
    for t in texts:
        cancelled.write(t)
    cancelled.cancel()
    left = store.table("chunks").count()
    writer = store.object_writer()
    for t in texts:
        writer.write(t)
    who = writer.finish()
    return spark.createDataFrame([(who.hex(), store.object_size(who), left)], "object_id string, size_bytes long, left_by_cancelled long")


# Records, transactions and notifications


def _suppliers(spark: SparkSession, sf_dir: str) -> Store:
    store = _new(spark)
    store.put_table("suppliers", table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))
    return store


SUPPLIERS = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@_add("store_open_read_only", SUPPLIERS)
def _open(spark, sf_dir):
    with _suppliers(spark, sf_dir) as store:
        root = store.root
    return Store.open(spark, root, read_only=True).table("suppliers")


@_add("store_crud", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'moved' ELSE s_name END AS s_name, s_nationkey, s_acctbal * CASE WHEN s_nationkey = 3 THEN 2 ELSE 1 END AS s_acctbal FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT -1, 'new', 0, 0.5")
def _crud(spark, sf_dir):
    store = _suppliers(spark, sf_dir)
    schema = store.table("suppliers").schema
    store.delete_rows("suppliers", "s_acctbal < 0")
    store.update("suppliers", "s_nationkey = 3", {"s_name": "'moved'", "s_acctbal": "s_acctbal * 2"})
    store.insert("suppliers", spark.createDataFrame([(-1, "new", 0, 0.5)], schema), ["s_suppkey"])
    return store.table("suppliers")


@_add("store_transactions", f"{SUPPLIERS} WHERE s_nationkey NOT IN (2, 5)")
def _transactions(spark, sf_dir):
    store = _suppliers(spark, sf_dir)
    store.begin()
    store.delete_rows("suppliers", "s_nationkey = 1")
    store.rollback()
    with store.transaction():
        store.delete_rows("suppliers", "s_nationkey = 2")
    store.savepoint("a")
    store.savepoint("b")
    store.delete_rows("suppliers", "s_nationkey = 4")
    store.rollback_to("b")
    store.delete_rows("suppliers", "s_nationkey = 5")
    store.release("a")
    return Store.open(spark, store.root).table("suppliers")


@_add("store_two_writers", f"{SUPPLIERS} WHERE s_nationkey NOT IN (1, 2)")
def _two_writers(spark, sf_dir):
    first = _suppliers(spark, sf_dir)
    second = Store.open(spark, first.root, busy_timeout=5.0)
    first.delete_rows("suppliers", "s_nationkey = 1")
    second.run(lambda s: s.delete_rows("suppliers", "s_nationkey = 2"))  # its snapshot is old: from the new one again
    return Store.open(spark, first.root).table("suppliers")


@_add("store_sql_arguments", "SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 1000 GROUP BY s_nationkey")
def _arguments(spark, sf_dir):
    return _suppliers(spark, sf_dir).sql("SELECT s_nationkey, count(*) AS n FROM suppliers WHERE s_acctbal > :least GROUP BY s_nationkey", {"least": 1000})


@_add("store_notifications", "SELECT row_number() OVER (ORDER BY n_nationkey) AS place, n_name AS payload FROM nation")
def _notifications(spark, sf_dir):
    store = _new(spark)
    inbox, other = store.listen("names"), store.listen("else")
    names = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    store.begin()
    store.notify("names", "rolled back")
    store.rollback()
    with store.transaction():
        for name in names:
            store.notify("names", name)
        assert inbox.try_receive() is None  # nothing before the commit
    got = []
    while item := inbox.try_receive():
        got.append((len(got) + 1, item.payload))
    assert other.try_receive() is None
    return spark.createDataFrame(got, "place long, payload string")


@_add("store_sql_notify", "SELECT n_name AS payload, 25 AS notified FROM nation")
def _sql_notify(spark, sf_dir):
    store = _new(spark)
    store.put_table("nations", table(spark, sf_dir, "nation"))
    inbox = store.listen("names")
    n = store.sql("SELECT notify('names', n_name) FROM nations").count()
    got = []
    while item := inbox.try_receive():
        got.append((item.payload, n))
    return spark.createDataFrame(got, "payload string, notified long")


@_add("stream_windows", "SELECT event_type AS channel, count(*) AS n FROM events GROUP BY event_type")
def _windows(spark, sf_dir):
    """The notification log as a stream, read to its end, in windows of event time with a watermark."""
    log, out = scratch(spark, "log"), scratch(spark, "windows")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), F.col("event_type").alias("channel"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("sent_at"))
    events.write.parquet(log)
    last = events.agg(F.max("sent_at")).first()[0]
    rows = feed.counts(feed.stream(spark, log), "1 hour", "1 minute")
    runs = lambda: rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    runs()
    # A later item of a channel of its own moves the watermark on, so that the last windows end.
    end = spark.createDataFrame([(-1, "end", "", last)], feed.LOG).withColumn("sent_at", F.col("sent_at") + F.expr("INTERVAL 2 DAYS"))
    end.write.mode("append").parquet(log)
    runs()
    return spark.read.parquet(out).groupBy("channel").agg(F.sum("n").alias("n"))


@_add("sql_glob", "SELECT s_name, s_name GLOB 'Supplier*[1-4]?' AS a, s_name GLOB '*#*[!0-9]' AS b FROM supplier")
def _glob(spark, sf_dir):
    register(spark)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("stratalode_glob")
    return spark.sql("SELECT s_name, glob_match('Supplier*[1-4]?', s_name) AS a, glob_match('*#*[^0-9]', s_name) AS b FROM stratalode_glob")


@_add("sql_zeroblob", "SELECT r_regionkey, repeat('00', r_regionkey::BIGINT) AS zeros FROM region")
def _zeroblob(spark, sf_dir):
    register(spark)
    table(spark, sf_dir, "region").createOrReplaceTempView("stratalode_zero")
    return spark.sql("SELECT r_regionkey, hex(zeroblob(cast(r_regionkey AS int))) AS zeros FROM stratalode_zero")


# Copies and bound stores


def _copied(name: str, act) -> None:
    _add(name, SUPPLIERS)(lambda spark, sf_dir: act(spark, _suppliers(spark, sf_dir)).table("suppliers"))


_copied("store_backup", lambda spark, s: s.backup(_path(spark)))
_copied("store_restore", lambda spark, s: restore(spark, s.backup(_path(spark)).root, _path(spark)))
_copied("store_compact", lambda spark, s: s.compact(_path(spark)))


@_add("store_vacuum", f"SELECT *, 1::BIGINT AS folders FROM ({SUPPLIERS} WHERE s_nationkey <> 1)")
def _vacuum(spark, sf_dir):
    store = _suppliers(spark, sf_dir)
    store.delete_rows("suppliers", "s_nationkey = 1")
    store.vacuum()
    folders = sum(n.startswith("suppliers-") for n in store.files.names(f"{store.root}/data"))
    return Store.open(spark, store.root).table("suppliers").withColumn("folders", F.lit(folders).cast("long"))


@_add("store_convert", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def _convert(spark, sf_dir):
    store = convert(spark, {t: table(spark, sf_dir, t) for t in ("nation", "region")}, _path(spark))
    return spark.createDataFrame([(t, store.table(t).count()) for t in store.user_tables()], "name string, n long")


@_add("store_split", f"SELECT {VECTOR_ENDS} FROM embeddings WHERE vec_id <> 7")
def _split(spark, sf_dir):
    """Vectors move to a bound store, which a commit that was cut off leaves ahead of the main one."""
    store = _vectors(spark, sf_dir)
    moved = store.split_store("vector", _path(spark))
    assert moved["vectors"] and not spark.read.parquet(*store.manifest["tables"]["vectors"]).count()
    store.delete_vector("emb", "7")
    bound = store.bound["vector"]
    bound.begin()
    bound.delete_vector("emb", "8")
    bound.manifest["epoch"] += 1
    bound.commit()  # the main store never names this epoch
    again = Store.open(spark, store.root)
    again.delete_vector("emb", "9")
    again.put_vector_rows("emb", tables.vectors(spark, sf_dir).filter("vector_id = '9'"))
    return _found(Store.open(spark, store.root))


@_add("store_inline", f"SELECT {VECTOR_ENDS} FROM embeddings")
def _inline(spark, sf_dir):
    """A copy of a store with a bound one holds everything itself; unbinding leaves the main store without the vectors."""
    store = _vectors(spark, sf_dir)
    store.split_store("vector", _path(spark))
    copy = store.backup(_path(spark))
    store.unbind_store("vector")
    assert not store.table("vectors").count() and not copy.bound
    return _found(copy)


# Inspection and salvage


@_add("store_summary", "SELECT 'objects' AS name, count(DISTINCT text) AS n FROM documents UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'user_tables', 1 UNION ALL SELECT 'issues', 0")
def _summary(spark, sf_dir):
    store = _objects(spark, sf_dir)
    store.create_vector_collection("emb", 64, "l2")
    store.put_vector_rows("emb", tables.vectors(spark, sf_dir))
    store.put_table("nations", table(spark, sf_dir, "nation"))
    found = store.doctor()
    rows = [(k, found["summary"][k]) for k in ("objects", "vectors", "user_tables")] + [("issues", sum(found["issue_counts"].values()))]
    return spark.createDataFrame(rows, "name string, n long")


@_add("store_columns", "SELECT * FROM (VALUES ('s_suppkey', 'bigint'), ('s_name', 'string'), ('s_nationkey', 'int'), ('s_acctbal', 'double')) AS t(name, type)")
def _columns(spark, sf_dir):
    found = _suppliers(spark, sf_dir).table_columns("suppliers")
    return spark.createDataFrame([(c["name"], c["type"]) for c in found], "name string, type string")


@_add("store_salvage", f"SELECT {VECTOR_ENDS} FROM embeddings")
def _salvage(spark, sf_dir):
    """Damaged rows stay behind: a vector of a wrong length and one of no collection."""
    store = _vectors(spark, sf_dir)
    damaged = store.table("vectors").limit(1).withColumn("values", F.slice("values", 1, 3)).withColumn("vector_id", F.lit("short"))
    lost = store.table("vectors").limit(1).withColumn("collection_name", F.lit("nowhere"))
    store._change({"vectors": ("append", damaged.unionByName(lost))})
    assert store.check()["issue_counts"]["vector"] >= 2
    return _found(store.salvage(_path(spark)))


@_add("store_numbered_edges", "SELECT conv_id::VARCHAR AS graph_name, count(*) AS n, max(turn) AS turns FROM conversations GROUP BY conv_id")
def _numbered(spark, sf_dir):
    """A graph for each conversation, loaded in bulk: turns are nodes, each replied to by the next."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("graph_name"), "turn")
    nodes = numbered(rows.select("graph_name", F.col("turn").cast("string").alias("node_id"), F.lit("turn").alias("kind"), F.lit("none").alias("target_type"), F.lit(None).cast("string").alias("target_namespace"), F.lit(None).cast("string").alias("target_ref"), "turn"), ["turn"])
    edges = numbered(rows.filter("turn > 0").select("graph_name", F.col("turn").cast("string").alias("from_node_id"), F.lit("replies_to").alias("edge_type"), (F.col("turn") - 1).cast("string").alias("to_node_id"), "turn"), ["turn"])
    store = _new(spark)
    names = nodes.select(F.col("graph_name").alias("name")).distinct().withColumn("created_order", F.xxhash64("name"))
    store._change({"graphs": ("append", names)})
    store.put_graph_rows(nodes, edges)
    n = store.table("graph_nodes").groupBy("graph_name").agg(F.count("*").alias("n"))
    e = store.table("graph_edges").groupBy("graph_name").agg(F.max(F.col("from_node_id").cast("long")).alias("turns"))
    return n.join(e, "graph_name", "left").select("graph_name", "n", F.coalesce("turns", F.lit(0)).alias("turns"))
