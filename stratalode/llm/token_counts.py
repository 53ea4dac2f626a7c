"""Token counts through a digest cache.

The cache is a Parquet table ``(content_digest, model_digest, n_tokens)`` in a
shared folder.  A call joins the distinct digests of its normalised contents to
the cache, fetches and encodes one text of each digest that misses, appends the
counts, and joins all rows to the cache again.  The joins move digests and ids
only.  Up to ``BROADCAST_DIGESTS`` missing digests are broadcast to the scan that
fetches their texts, so a text with a known count never moves; with more, and on
an empty cache, texts are dealt by digest, the first of the equal texts of a task.
The rows of a digest that very many copies share do not move at all.

Normalisation is what the tokenizer itself ignores: for the SentencePiece model
used here (identity normaliser, white space kept) that is nothing but null
against empty, so ``normalise`` defaults to ``coalesce(text, '')``; a tokenizer
that folds more can be given a stronger expression.

Defined results: null and empty texts share one digest and count what the
library gives for ""; repeated rows and ids stay repeated; an empty table
appends nothing.  A lost executor costs its own tasks only: appended files are
committed by the driver, and a count is a function of its digests, so a row
appended twice by two calls is taken once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalode.llm.runtime import hot_keys, join_hot, materialize, new_dir, small_batches, steps, strings

#: Missing digests (32 bytes each) that may be broadcast to pick their texts; with more, a shuffle join does it.
BROADCAST_DIGESTS = 200_000

CACHE = T.StructType([T.StructField("content_digest", T.BinaryType()), T.StructField("model_digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def sentencepiece_counter(data: bytes) -> Callable[[], Callable[[list[str]], list[int]]]:
    def make():
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(ids) for ids in library.encode(texts, num_threads=1)]

    return make


def tokenizers_counter(data: bytes) -> Callable[[], Callable[[list[str]], list[int]]]:
    def make():
        from tokenizers import Tokenizer

        library = Tokenizer.from_buffer(data)
        library.no_truncation()
        library.no_padding()
        return lambda texts: [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]

    return make


def load_counter(path: str) -> tuple[bytes, Callable]:
    """The digest of a tokenizer file and a maker of its counter, by the kind of file."""
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.sha256(data).digest(), (sentencepiece_counter if path.endswith(".model") else tokenizers_counter)(data)


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The cache, one row a key; empty where nothing was appended yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache_dir)


def count_tokens(
    docs: DataFrame,
    model_path: str,
    cache_dir: str | None = None,
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    limit: int = 4096,
) -> DataFrame:
    """All columns of ``docs``, and n_bytes, n_tokens, over_limit.

    ``cache_dir`` is the cache to use and extend (a new one if None).
    """
    spark = docs.sparkSession
    small_batches(spark)
    cache_dir = cache_dir or new_dir(spark, "token-cache")
    model_digest, counter = load_counter(model_path)
    normal = normalise or (lambda c: c)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    content = normal(text)
    model = F.lit(bytearray(model_digest))
    cached = read_cache(spark, cache_dir).filter(F.col("model_digest") == model)

    contents = docs.select(F.unhex(F.sha2(content, 256)).alias("content_digest"), content.alias("content"))
    if not cached.isEmpty():
        misses = materialize(contents.select("content_digest").distinct().join(cached.select("content_digest"), "content_digest", "left_anti"), "token-misses")
        n = misses.count()
        contents = contents.join(F.broadcast(misses) if n <= BROADCAST_DIGESTS else misses, "content_digest", "left_semi")
    # Partial aggregation keeps one text a digest and task, whatever the number of copies.
    firsts = contents.groupBy("content_digest").agg(F.first("content").alias("content"))

    def run(batches):
        count = counter()
        for batch in batches:
            texts = strings(batch.column(1))
            for i, j in steps(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([model_digest] * (j - i), pa.binary()), pa.array(count(texts[i:j]), pa.int64())], names=CACHE.names)

    firsts.mapInArrow(run, CACHE).write.mode("append").parquet(cache_dir)

    counts = read_cache(spark, cache_dir).filter(F.col("model_digest") == model).groupBy("content_digest").agg(F.max("n_tokens").alias("__n"))
    new = {"n_bytes", "n_tokens", "over_limit"}
    kept = [c for c in docs.columns if c not in new]
    keyed = docs.select(*[docs[f"`{c}`"] for c in kept], F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("content_digest"))
    sizes = keyed.groupBy("content_digest").agg(F.count("*").alias("size"))
    joined = join_hot(keyed, counts, "content_digest", hot_keys(sizes, "content_digest", docs.count()), "left")
    return joined.select(*[f"`{c}`" for c in kept], "n_bytes", F.col("__n").alias("n_tokens"), (F.col("__n") > limit).alias("over_limit"))
