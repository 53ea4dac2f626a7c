"""What the operators share: the shared folder, materialised steps, Arrow helpers.

Every intermediate that is read more than once is written as Parquet below the
folder named by ``spark.checkpoint.dir``, so that a lost executor costs a retry
of its own tasks only.  Nothing uses ``localCheckpoint`` or machine-local files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that one Python step holds as lists at a time.
STEP_CHARS = 300_000
#: Rows and bytes of an Arrow batch, where the session has Spark's defaults: large batches of texts only cost memory.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20

#: The white space of every word rule here: space, and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; with a local master only, one of this process where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="stratalode-"))
        at = _own[0]
    return at.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    for key, default, value in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", str(BATCH_BYTES))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stratalode/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``materialize`` that nothing reads again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text is empty.

    Other columns never reach the operator, so their names cannot clash.
    """
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def steps(texts: list[str], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of whole texts with about ``most`` characters each."""
    i = size = 0
    for j, x in enumerate(texts):
        size += len(x)
        if size >= most:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def map_text(
    docs: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str]], list]],
    text_col: str = "text",
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """Append columns computed from whole texts, a batch at a time.

    ``make()`` runs once for each Python task and returns a function from texts
    to one list or Arrow array per field.  All columns of ``docs`` (or those in
    ``keep``) stay; one that has the name of a new field is replaced by it.
    """
    small_batches(docs.sparkSession)
    new = {f.name for f in fields}
    kept = [f for f in docs.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    source = docs if text_col not in new else docs.withColumn("__text", docs[text_col])
    column = text_col if text_col not in new else "__text"
    names = [f.name for f in kept]
    source = source.select(*[source[f"`{n}`"] for n in dict.fromkeys([*names, column])])
    schema = T.StructType([*kept, *fields])
    arrow = [to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index(column)))
            for i, j in steps(texts):
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(work(texts[i:j]), arrow, strict=True)]
                old = [batch.column(batch.schema.get_field_index(n)).slice(i, j - i) for n in names]
                yield pa.RecordBatch.from_arrays([*old, *made], names=[*names, *[f.name for f in fields]])

    return source.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, to_arrow(f.dataType)) for f in kind.fields])
    return simple[kind.simpleString()]


def hot_keys(sizes: DataFrame, key: str, total: int, share: int = 1_000, least: int = 1_000) -> list:
    """Keys of ``sizes`` (key, size) that hold over ``1 / share`` of ``total`` rows, and over ``least``; fewer than ``share``."""
    return [r[0] for r in sizes.filter((F.col("size") > max(least, total // share)) & F.col(key).isNotNull()).select(key).collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``left`` joined to the unique keys of ``right``; rows of ``hot`` keys stay where they are.

    A hot key's one row of ``right`` is broadcast (there are fewer than a
    thousand, see ``hot_keys``), so no task gets all rows of such a key; the
    other keys are shuffled.
    """
    if not hot:
        return left.join(right, key, how)
    kind = right.schema[key].dataType
    values = [F.lit(bytearray(k) if isinstance(k, (bytes, bytearray)) else k).cast(kind) for k in hot]
    is_hot = F.coalesce(F.col(key).isin(*values), F.lit(False))
    kept = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    return kept.unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key, how))


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[starts[k] : starts[k] + lens[k]], one after another."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lens) - lens
    return flat[np.repeat(starts - before, lens) + np.arange(total)]


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if len(keys):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        yield from zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(keys)].tolist(), strict=True)


def session(name: str = "stratalode-llm", cpus: str = "*", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
