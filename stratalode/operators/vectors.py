"""Exact vector search over (vector_id, values) rows.

One search is one scan: distances are computed where the rows are read, in
Arrow batches; a batch hands on its k best only, and these are merged by
``TakeOrderedAndProject``.  Ties fall by the bytes of the id.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalode import errors as E
from stratalode import validate
from stratalode.functions import kernels

#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 100_000
FOUND = "rank long, vector_id string, distance double"


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint, if it was counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def nearest_rows(vectors: DataFrame, queries: list[list[float]], metric: str, limit: int | None, max_distance: float | None = None) -> DataFrame:
    """(query, vector_id, distance): each batch's nearest rows to each query, by its place in ``queries``.

    A damaged row (another length, a value that is not finite, no norm under
    cosine) fails the job, whatever its distance.
    """
    queries = [kernels.stored(q) for q in queries]
    dims = len(queries[0])

    def run(batches):
        for batch in batches:
            ids, m = batch.column(0), kernels.matrix(batch.column(1), dims)
            for n, q in enumerate(queries):
                d = kernels.distances(metric, q, m)
                if max_distance is not None:
                    near = (at := (d <= max_distance).nonzero()[0])[kernels.nearest(d[at], limit)]
                else:
                    near = kernels.nearest(d, limit)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(near), pa.int32()), ids.take(pa.array(near)), pa.array(d[near])], names=["query", "vector_id", "distance"])

    return vectors.select("vector_id", "values").mapInArrow(run, "query int, vector_id string, distance double")


def search(
    vectors: DataFrame,
    query: list[float],
    metric: str,
    limit: int | None = 10,
    max_distance: float | None = None,
    candidates: DataFrame | None = None,
    exclude: str | None = None,
) -> DataFrame:
    """rank, vector_id, distance of the nearest vectors.

    ``max_distance`` is inclusive; ``candidates`` (first column: ids) may repeat
    ids and name missing ones; ``exclude`` is left out, also as a candidate.
    With ``limit`` None all rows within ``max_distance`` come back.  Limit 0
    gives no row, and reads none.
    """
    query = validate.values(query, len(query), metric)
    if limit is None and max_distance is None:
        raise E.VectorInvalid("a search needs a limit, a max_distance or both")
    if candidates is not None:
        ids = candidates.select(F.col(candidates.columns[0]).cast("string").alias("vector_id")).distinct()
        vectors = vectors.join(bounded(ids), "vector_id", "left_semi")
    if exclude is not None:
        vectors = vectors.filter(F.col("vector_id") != exclude)
    if max_distance is not None:
        max_distance = validate.max_distance(max_distance)
    if limit is not None and not validate.limit(limit):
        return vectors.sparkSession.createDataFrame([], FOUND)
    found = nearest_rows(vectors, [query], metric, limit, max_distance).select("vector_id", "distance")
    if limit is not None:
        # The k best of all; numbering them sees k rows only.
        found = found.orderBy("distance", "vector_id").limit(limit)
        return found.select(F.row_number().over(Window.orderBy("distance", "vector_id")).cast("long").alias("rank"), "vector_id", "distance")
    return numbered(found)


def numbered(found: DataFrame) -> DataFrame:
    """Global ranks without sorting all rows in one task: sorted ranges, then their sizes are added up."""
    from stratalode.session import stored

    ranged = found.repartitionByRange("distance", "vector_id").sortWithinPartitions("distance", "vector_id")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "ranked")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("distance", "vector_id"))
    return ranged.withColumn("place", place).join(F.broadcast(before), "part").select((F.col("before") + F.col("place")).cast("long").alias("rank"), "vector_id", "distance")


def search_by_id(vectors: DataFrame, source: str, metric: str, **kw) -> DataFrame:
    """Search around a stored vector, which is not among its own results."""
    rows = vectors.filter(F.col("vector_id") == source).select("values").limit(1).collect()
    if not rows:
        raise E.VectorNotFound(source)
    return search(vectors, list(rows[0][0]), metric, exclude=source, **kw)


def search_many(vectors: DataFrame, queries: DataFrame, metric: str, limit: int, block: int = 256) -> DataFrame:
    """query_id, rank, vector_id, distance: the nearest ``limit`` vectors of each query row (query_id, values).

    The stated query set is taken in blocks of ``block``; each block meets every
    vector in one scan, and each batch hands on its ``limit`` best a query.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    out, held = None, []

    def add() -> None:
        nonlocal out
        rows = nearest_rows(vectors, [v for _, v in held], metric, limit)
        names = F.array(*[F.lit(q) for q, _ in held])
        rows = rows.select(F.get(names, F.col("query")).cast(kind).alias("query_id"), "vector_id", "distance")
        out = rows if out is None else out.unionByName(rows)
        held.clear()

    for r in queries.select("query_id", "values").toLocalIterator():
        held.append((r[0], list(r[1])))
        if len(held) == block:
            add()
    if held:
        add()
    if out is None:
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, {FOUND}")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vector_id"))
    return out.withColumn("rank", best.cast("long")).filter(F.col("rank") <= limit).select("query_id", "rank", "vector_id", "distance")


def last_wins(batch: DataFrame, key: list[str], position: str) -> DataFrame:
    """Of the rows of one key, the one put last."""
    best = F.max_by(F.struct(*[c for c in batch.columns if c not in key]), F.col(position)).alias("row")
    return batch.groupBy(*key).agg(best).select(*key, "row.*")


def collection_info(collections: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each collection with its number of vectors and bytes, by name."""
    counts = vectors.groupBy(F.col("collection_name").alias("name")).agg(F.count("*").alias("n"))
    out = collections.join(counts, "name", "left").withColumn("vector_count", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("name", "dimensions", "metric", "vector_count", (F.col("vector_count") * F.col("dimensions") * 4).cast("long").alias("value_bytes"))
