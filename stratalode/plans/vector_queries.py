"""Vector queries over ``embeddings`` and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.functions import scalars
from stratalode.functions.sql import register
from stratalode.operators import vectors as V
from stratalode.plans import tables
from stratalode.session import table
from stratalode.validate import METRICS

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Distances in SQL whose sums run in the same order.
_DIST = {
    "dot": "-list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])",
    "cosine": "1 - list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))",
    "l2": "sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), lambda a, b: a + b))",
}
MAX = {"cosine": 0.9, "l2": 1.3, "dot": 0.05}


def _query(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _sql(metric: str, where: str = "", limit: int | None = 10, source: int = 0, columns: str = "rank, vector_id, distance") -> str:
    cut = f"WHERE rank <= {limit}" if limit is not None else ""
    return f"""WITH d AS (SELECT v.vec_id::VARCHAR AS vector_id, v.label, {_DIST[metric]} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = {source}) q),
r AS (SELECT row_number() OVER (ORDER BY distance, vector_id) AS rank, vector_id, distance, label FROM d {where})
SELECT {columns} FROM r {cut}"""


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of two labels, some twice, and one that is not there."""
    ids = table(spark, sf_dir, "embeddings").filter(F.col("label").isin(1, 2)).select(F.col("vec_id").cast("string").alias("vector_id"))
    return ids.unionByName(ids.filter("vector_id < '5'")).unionByName(spark.createDataFrame([("missing",)], "vector_id string"))


for _m in METRICS:
    for _by in (False, True):
        _own = "vector_id <> '7'" if _by else "true"
        for _in in (False, True):
            for _within in (False, True):
                _name = "vec_" + ("by_id_" if _by else "") + ("in_" if _in else "") + ("within_" if _within else "") + ("" if _by or _in or _within else "search_") + _m
                _where = "WHERE " + _own + (" AND label IN (1, 2)" if _in else "") + (f" AND distance <= {MAX[_m]}" if _within else "")

                def _run(spark, sf_dir, m=_m, by=_by, inside=_in, within=_within):
                    rows = tables.vectors(spark, sf_dir)
                    kw = {"limit": 10, "max_distance": MAX[m] if within else None, "candidates": _candidates(spark, sf_dir) if inside else None}
                    if by:
                        return V.search_by_id(rows, "7", m, **kw)
                    return V.search(rows, _query(spark, sf_dir), m, **kw)

                QUERIES[_name] = _run
                SQL[_name] = _sql(_m, _where, 10, 7 if _by else 0)


@_add("vec_within_unbounded", _sql("l2", f"WHERE distance <= {MAX['l2']}", None))
def _unbounded(spark, sf_dir):
    return V.search(tables.vectors(spark, sf_dir), _query(spark, sf_dir), "l2", None, MAX["l2"])


@_add("vec_distance_scalar", f"SELECT v.vec_id, {_DIST['cosine']} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def _scalar(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", scalars.distance("cosine", F.array(*[F.lit(x).cast("float") for x in _query(spark, sf_dir)]), F.col("embedding")).alias("distance"))


@_add("vec_distance_by_id", f"SELECT v.vec_id, q.vec_id AS source_id, {_DIST['l2']} AS distance FROM embeddings v JOIN embeddings q ON q.vec_id = v.label")
def _by_id(spark, sf_dir):
    """The distance of each vector to the vector whose id is its label: two columns of one row."""
    e = table(spark, sf_dir, "embeddings")
    q = e.select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("q"))
    return e.join(q, e["label"] == q["source_id"]).select("vec_id", "source_id", scalars.distance("l2", F.col("q"), F.col("embedding")).alias("distance"))


@_add("vec_sql_search", _sql("l2", "WHERE vector_id <> '7'", 5, 7))
def _sql_search(spark, sf_dir):
    register(spark, tables.vectors(spark, sf_dir))
    return spark.sql("SELECT * FROM vector_search_l2('emb', src => '7', k => 5)")


@_add("vec_lateral_search", f"""WITH d AS (SELECT q.vec_id AS source_id, v.vec_id::VARCHAR AS vector_id, {_DIST["l2"]} AS distance FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id IN (3, 5, 9)) q WHERE v.vec_id <> q.vec_id),
r AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY distance, vector_id) AS rank, vector_id, distance FROM d) SELECT * FROM r WHERE rank <= 3""")
def _lateral(spark, sf_dir):
    """A table function called for each row of a query."""
    register(spark, tables.vectors(spark, sf_dir))
    return spark.sql("SELECT o.src AS source_id, s.rank, s.vector_id, s.distance FROM (SELECT explode(array(3L, 5L, 9L)) AS src) o, LATERAL vector_search_l2('emb', src => cast(o.src AS string), k => 3) s")


@_add("vec_search_metadata", _sql("cosine", "", 20, 0, "rank, vector_id, distance, label"))
def _metadata(spark, sf_dir):
    """Search gives ids; metadata comes from a join with the few results."""
    rows = tables.vectors(spark, sf_dir)
    found = V.search(rows, _query(spark, sf_dir), "cosine", 20)
    return rows.select("vector_id", "label").join(F.broadcast(found), "vector_id").select("rank", "vector_id", "distance", "label")


@_add(
    "vec_topk_per_query",
    f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id::VARCHAR AS vector_id, {_DIST["l2"]} AS distance FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vector_id) AS rank, vector_id, distance FROM d) SELECT * FROM r WHERE rank <= 5""",
)
def _per_query(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("values"))
    return V.search_many(tables.vectors(spark, sf_dir), q, "l2", 5)


@_add(
    "vec_collection_stats",
    "SELECT 'emb' AS name, 64::INTEGER AS dimensions, 'cosine' AS metric, count(*) AS vector_count, count(*) * 256 AS value_bytes FROM embeddings UNION ALL SELECT 'void', 8, 'l2', 0, 0",
)
def _stats(spark, sf_dir):
    return V.collection_info(tables.collections(spark), tables.vectors(spark, sf_dir))


@_add(
    "vec_last_wins",
    """WITH b AS (SELECT (vec_id % 50)::VARCHAR AS vector_id, vec_id AS position, label FROM embeddings)
SELECT vector_id, position, label FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY position DESC) AS r FROM b) WHERE r = 1""",
)
def _last(spark, sf_dir):
    b = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).cast("string").alias("vector_id"), F.col("vec_id").alias("position"), "label")
    return V.last_wins(b, ["vector_id"], "position").select("vector_id", "position", "label")


@_add("vec_codec_roundtrip", "SELECT vec_id, 4 * len(embedding) AS n_bytes, true AS same FROM embeddings")
def _codec(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("raw", scalars.encode_f32("embedding"))
    return e.select("vec_id", F.octet_length("raw").cast("long").alias("n_bytes"), (scalars.decode_f32("raw") == F.col("embedding")).alias("same"))
