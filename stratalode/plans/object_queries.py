"""Object, diagnostic and notification queries and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalode.functions.scalars import content_id, hex_id
from stratalode.operators import diagnose
from stratalode.operators import objects as O
from stratalode.plans import tables
from stratalode.session import stored, table
from stratalode.streaming.hub import queue_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}
SIZE = 1000


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _store(spark, sf_dir, boundaries=None):
    """The three tables of all texts, written once."""
    empty = [spark.createDataFrame([], s) for s in ("object_id binary", "chunk_hash binary", "object_id binary")]
    kw = {"boundaries": boundaries} if boundaries else {}
    return tuple(stored(df, "objects") for df in O.put(tables.blobs(spark, sf_dir), *empty, **kw))


def _fixed(spark, sf_dir):
    return _store(spark, sf_dir, O.fixed(SIZE))


# Texts cut every SIZE bytes, in SQL on their hexadecimal form.
FIXED = f"""o AS (SELECT sha256(text) AS id, min(hex(encode(text))) AS h FROM documents WHERE text IS NOT NULL GROUP BY 1),
m AS (SELECT id, i AS chunk_index, substr(h, i * {2 * SIZE} + 1, {2 * SIZE}) AS piece FROM (SELECT id, h, unnest(range(0, (length(h) + {2 * SIZE} - 1) // {2 * SIZE})) AS i FROM o)),
c AS (SELECT sha256(unhex(piece)) AS hash, piece, id, chunk_index, length(piece) // 2 AS size FROM m)"""


@_add("obj_ids", "SELECT doc_id, sha256(text) AS object_id, strlen(text) AS size_bytes FROM documents")
def _ids(spark, sf_dir):
    rows = tables.object_rows(spark, sf_dir)
    return rows.select("doc_id", hex_id(F.col("object_id")).alias("object_id"), "size_bytes")


@_add("obj_dedup", "SELECT count(*) AS texts, count(DISTINCT sha256(text)) AS objects, sum(strlen(text))::BIGINT AS text_bytes, (SELECT sum(s)::BIGINT FROM (SELECT max(strlen(text)) AS s FROM documents GROUP BY sha256(text))) AS object_bytes FROM documents")
def _dedup(spark, sf_dir):
    rows = tables.object_rows(spark, sf_dir)
    per = rows.groupBy("object_id").agg(F.count("*").alias("n"), F.max("size_bytes").alias("size"))
    return per.agg(F.sum("n").alias("texts"), F.count("*").alias("objects"), F.sum(F.col("n") * F.col("size")).alias("text_bytes"), F.sum("size").alias("object_bytes"))


@_add("obj_roundtrip", "SELECT DISTINCT sha256(text) AS object_id, strlen(text) AS size_bytes, true AS sound FROM documents")
def _round(spark, sf_dir):
    o, c, m = _store(spark, sf_dir)
    return O.get(o, c, m).select(hex_id(F.col("object_id")).alias("object_id"), F.octet_length("data").cast("long").alias("size_bytes"), "sound")


@_add("obj_chunk_invariants", "SELECT DISTINCT sha256(text) AS object_id, strlen(text) AS total, true AS sound FROM documents")
def _shape(spark, sf_dir):
    o, _, m = _store(spark, sf_dir)
    total = m.groupBy("object_id").agg(F.sum("size_bytes").alias("t"))
    rows = O.manifest_shape(o, m).join(total, "object_id", "left")
    return rows.select(hex_id(F.col("object_id")).alias("object_id"), F.coalesce("t", F.lit(0)).cast("long").alias("total"), "sound")


@_add("obj_range", "SELECT DISTINCT sha256(text) AS object_id, CASE WHEN strlen(text) < 1500 THEN NULL ELSE sha256(unhex(substr(hex(encode(text)), 3001, 8000))) END AS part_id FROM documents")
def _range(spark, sf_dir):
    o, c, m = _store(spark, sf_dir)
    rows = O.read_range(o, m, c, 1500, 4000)
    return rows.select(hex_id(F.col("object_id")).alias("object_id"), hex_id(content_id(F.col("data"))).alias("part_id"))


@_add("obj_chunks_fastcdc")
def _cdc(spark, sf_dir):
    _, _, m = _store(spark, sf_dir)
    return m.select(hex_id(F.col("object_id")).alias("object_id"), "chunk_index", hex_id(F.col("chunk_hash")).alias("chunk_hash"), "offset", "size_bytes")


@_add("obj_manifest_fixed", f"WITH {FIXED} SELECT id AS object_id, chunk_index, hash AS chunk_hash, (chunk_index * {SIZE})::BIGINT AS \"offset\", size::BIGINT AS size_bytes FROM c")
def _manifest(spark, sf_dir):
    _, _, m = _fixed(spark, sf_dir)
    return m.select(hex_id(F.col("object_id")).alias("object_id"), "chunk_index", hex_id(F.col("chunk_hash")).alias("chunk_hash"), "offset", "size_bytes")


@_add(
    "obj_stats",
    f"""WITH {FIXED}, s AS (SELECT count(*) AS object_count, coalesce(sum(length(h) // 2), 0)::BIGINT AS object_bytes, min(length(h) // 2)::BIGINT AS min_size, max(length(h) // 2)::BIGINT AS max_size FROM o),
k AS (SELECT hash, max(size) AS size FROM c GROUP BY hash), kk AS (SELECT count(*) AS chunk_count, coalesce(sum(size), 0)::BIGINT AS chunk_bytes FROM k),
mm AS (SELECT count(*) AS manifest_rows, coalesce(sum(size), 0)::BIGINT AS manifest_bytes FROM c)
SELECT s.*, kk.*, 0::BIGINT AS loose_chunk_count, mm.*, greatest(0, manifest_bytes - chunk_bytes)::BIGINT AS dedup_saved_bytes FROM s, kk, mm""",
)
def _stats(spark, sf_dir):
    return O.stats(*_fixed(spark, sf_dir))


@_add("chunk_refcounts", f"WITH {FIXED} SELECT hash AS chunk_hash, max(size)::BIGINT AS size_bytes, count(*) AS refs FROM c GROUP BY hash")
def _refs(spark, sf_dir):
    _, c, m = _fixed(spark, sf_dir)
    return O.references(c, m).withColumn("chunk_hash", hex_id(F.col("chunk_hash")))


_GONE = "SELECT sha256(text) AS id FROM documents WHERE doc_id % 3 = 0"


@_add("loose_chunks", f"WITH {FIXED} SELECT DISTINCT hash AS chunk_hash, size::BIGINT AS size_bytes FROM c WHERE hash NOT IN (SELECT hash FROM c WHERE id NOT IN ({_GONE}))")
def _loose(spark, sf_dir):
    """Chunks left without reference once the manifests of every third document are gone."""
    _, c, m = _fixed(spark, sf_dir)
    gone = tables.object_rows(spark, sf_dir).filter("doc_id % 3 = 0").select("object_id").distinct()
    return O.loose_chunks(c, m.join(gone, "object_id", "left_anti")).select(hex_id(F.col("chunk_hash")).alias("chunk_hash"), "size_bytes")


@_add("obj_gc", f"WITH {FIXED}, k AS (SELECT * FROM c WHERE id NOT IN ({_GONE})) SELECT (SELECT count(DISTINCT id) FROM o WHERE id NOT IN ({_GONE})) AS objects, (SELECT count(DISTINCT hash) FROM k) AS chunks, (SELECT count(*) FROM k) AS manifest_rows")
def _gc(spark, sf_dir):
    gone = tables.object_rows(spark, sf_dir).filter("doc_id % 3 = 0").select("object_id")
    o, c, m = O.delete(*_fixed(spark, sf_dir), gone)
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((o, "objects"), (c, "chunks"), (m, "manifest_rows"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # single rows


@_add("diag_vectors", "SELECT 'vector_integrity' AS kind, 'emb' AS collection_name, vec_id::VARCHAR AS vector_id FROM embeddings WHERE vec_id % 7 = 0")
def _bad_vectors(spark, sf_dir):
    """Every seventh vector damaged: cut short, of norm 0, or with a value that is not finite."""
    v = tables.vectors(spark, sf_dir)
    hit = F.col("vector_id").cast("long") % 21
    nan = F.array_repeat(F.lit(float("nan")).cast("float"), 64)
    values = F.when(hit == 0, F.slice("values", 1, 10)).when(hit == 7, F.array_repeat(F.lit(0).cast("float"), 64)).when(hit == 14, nan).otherwise(F.col("values"))
    return diagnose.vector_issues(tables.collections(spark), v.withColumn("values", values)).select("kind", "collection_name", "vector_id")


@_add("diag_targets", "SELECT 'node_object_target_missing' AS kind, 'doc:' || doc_id AS node_id FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'node_object_target_invalid', 'doc:' || doc_id FROM documents WHERE doc_id % 5 = 1")
def _targets(spark, sf_dir):
    """Nodes for documents: a fifth points at an object that is not there, a fifth at no object id at all."""
    rows = tables.object_rows(spark, sf_dir)
    rest = F.col("doc_id") % 5
    ref = F.when(rest == 0, F.sha2(F.concat(F.lit("lost"), F.col("doc_id").cast("string")), 256)).when(rest == 1, F.lit("no id")).otherwise(hex_id(F.col("object_id")))
    nodes = rows.select(F.lit("docs").alias("graph_name"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"), F.lit("object").alias("target_type"), F.lit(None).cast("string").alias("target_namespace"), ref.alias("target_ref"))
    none = spark.createDataFrame([], "chunk_hash binary, collection_name string, vector_id string")
    return diagnose.target_issues(nodes, rows.select("object_id"), none, none).select("kind", "node_id")


@_add("diag_objects", f"WITH {FIXED}, bad AS (SELECT hash FROM c GROUP BY hash HAVING substr(hash, 1, 1) = '0') SELECT 'chunk_integrity' AS kind, id AS object_id_hex, hash AS chunk_hash_hex FROM c WHERE hash IN (SELECT hash FROM bad) UNION ALL SELECT DISTINCT 'object_integrity', id, NULL FROM c WHERE hash IN (SELECT hash FROM bad)")
def _bad_chunks(spark, sf_dir):
    """Chunks whose hash begins with 0 overwritten by zero bytes."""
    o, c, m = _fixed(spark, sf_dir)
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("size_bytes").cast("int")))
    c = c.withColumn("data", F.when(F.hex("chunk_hash").startswith("0"), zeros).otherwise(F.col("data")))
    return diagnose.object_issues(o, c, m).select("kind", "object_id_hex", "chunk_hash_hex")


@_add("salvage_plan", "SELECT 'vectors' AS area, count(*) AS total, count(*) FILTER (vec_id % 7 = 0) AS skipped, count(*) FILTER (vec_id % 7 <> 0) AS recoverable FROM embeddings")
def _salvage(spark, sf_dir):
    issues = _bad_vectors(spark, sf_dir).agg(F.count("*").alias("n"))
    total = tables.vectors(spark, sf_dir).agg(F.count("*").alias("total"))
    one = total.crossJoin(issues)  # single rows
    return one.select(F.lit("vectors").alias("area"), "total", F.least("total", "n").alias("skipped"), (F.col("total") - F.least("total", "n")).alias("recoverable"))


@_add(
    "notify_queue",
    """WITH q AS (SELECT event_type AS channel, event_id AS sequence, props AS payload, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT channel, sequence, payload, (CASE WHEN place = 1024 AND n > 1024 THEN n - 1024 ELSE 0 END)::BIGINT AS dropped_before FROM q WHERE place <= 1024""",
)
def _queue(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return queue_rows(e.select(F.col("event_type").alias("channel"), F.col("event_id").alias("sequence"), F.col("props").alias("payload")))
