"""A store: a folder of immutable Parquet snapshots and numbered manifests.

``<root>/manifests/<n>.json`` names the data folder of each table.  A commit
writes manifest n + 1 and fails with ``Busy`` if it is there already, so writers
of one store are serialised without locks, and readers keep their snapshot.  A
transaction is a stack of table maps in the driver; savepoints are its frames.
Bound stores write theirs first, and the main one names the epoch of each: only
its manifest makes the commit, and bound manifests ahead of it are passed over.

Parts of the vector and graph tables that hold the rows of one collection or
graph say so in their name (a digest of it), so a search reads only the parts of
its collection.  A part is a folder or, once some of its files were rewritten,
what is left of them: an update or delete rewrites the files that hold its keys.

Private tables may be routed to a bound store of their own (objects, vectors).
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalode import errors as E
from stratalode import schemas, validate
from stratalode.functions import fastcdc, scalars, sql
from stratalode.operators import diagnose, graph, inspect, objects, vectors
from stratalode.sources.files import Files
from stratalode.streaming.hub import Hub, Subscription

SUFFIX = ".strata"
MAGIC, VERSION = "stratalode-store", 1
NOTIFY = re.compile(r"\s*SELECT\s+notify\s*\(", re.IGNORECASE)
ROLES = {"object": schemas.OBJECT_TABLES, "vector": schemas.VECTOR_TABLES}
DEFAULT_GRAPH = "default"
#: The keys of nodes and edges.
NODE, EDGE = ["graph_name", "node_id"], ["graph_name", "from_node_id", "edge_type", "to_node_id"]
#: The column that names the owner of a row, where parts can belong to one owner.
OWNER = {"vectors": "collection_name", "graph_nodes": "graph_name", "graph_edges": "graph_name"}


class Store:
    """One handle on a store; see ``create`` and ``open``."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict, number: int, read_only: bool):
        self.spark, self.root, self.files = spark, root, Files(spark)
        self.manifest, self.number, self.read_only = manifest, number, read_only
        self.frames: list[tuple[str | None, dict]] = []
        self.hub = Hub()
        self.bound: dict[str, Store] = {}
        self.closed = False
        self.busy_timeout = 0.0
        self.changes = self.total_changes = 0
        self.last_insert_id = 0

    # Opening and closing

    @classmethod
    def create(cls, spark: SparkSession, root: str, role: str = "main") -> Store:
        """A new store; never over another one."""
        root = root.rstrip("/")
        if not root.endswith(SUFFIX):
            raise E.NotStorePath(root)
        files = Files(spark)
        if files.exists(root):
            raise E.DestinationExists(root)
        manifest = {"magic": MAGIC, "format_version": VERSION, "store_id": uuid.uuid4().hex, "role": role, "epoch": 0, "bound_set_id": None, "tables": {}, "user_tables": {}, "bound": {}}
        store = cls(spark, root, manifest, 0, False)
        for name, schema in schemas.PRIVATE.items():
            manifest["tables"][name] = store._write(spark.createDataFrame([], schema), name)
        if not files.create(f"{root}/manifests/{0:012d}.json", json.dumps(manifest)):
            raise E.DestinationExists(root)
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str, read_only: bool = False, load_bound: bool = True, busy_timeout: float = 0.0) -> Store:
        """A handle on the newest snapshot; ``busy_timeout`` (seconds) is for ``run``."""
        store = cls._open(spark, root, read_only, load_bound)
        store.busy_timeout = busy_timeout
        return store

    @classmethod
    def _open(cls, spark: SparkSession, root: str, read_only: bool, load_bound: bool, epoch: int | None = None) -> Store:
        root = root.rstrip("/")
        if not root.endswith(SUFFIX):
            raise E.NotStorePath(root)
        files = Files(spark)
        names = files.names(f"{root}/manifests")
        if not names:
            raise E.NotStore(root)
        # A bound store is read at the epoch that the main one names: a commit that was cut off leaves a later one.
        for name in reversed(names):
            manifest = json.loads(files.read(f"{root}/manifests/{name}"))
            if epoch is None or manifest.get("epoch", 0) <= epoch:
                break
        if manifest.get("magic") != MAGIC:
            raise E.NotStore(root)
        if manifest.get("format_version") != VERSION:
            raise E.UnsupportedVersion(str(manifest.get("format_version")))
        store = cls(spark, root, manifest, int(names[-1].split(".")[0]), read_only)
        for name, schema in schemas.PRIVATE.items():
            at = manifest["tables"].get(name)
            if at is None or [(f.name, f.dataType) for f in spark.read.parquet(*at).schema] != [(f.name, f.dataType) for f in schema]:
                raise E.NotStore(f"{root}: table {name}")
        if load_bound:
            for role, entry in manifest["bound"].items():
                other = cls._open(spark, entry["path"], read_only, False, entry["epoch"])
                m = other.manifest
                if m["role"] != role or m["store_id"] != entry["store_id"] or m["bound_set_id"] != entry["bound_set_id"] or m["epoch"] != entry["epoch"]:
                    raise E.BoundStoreInvalid(f"{role}: {entry['path']}")
                store.bound[role] = other
        return store

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # Tables

    @staticmethod
    def _mark(owner: str) -> str:
        return hashlib.sha256(owner.encode()).hexdigest()[:24]

    def _write(self, df: DataFrame, name: str, owner: str | None = None) -> list[str]:
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}" + (f"-of-{self._mark(owner)}" if owner is not None else "")
        df.write.parquet(path)
        return [path]

    @staticmethod
    def _folder(path: str) -> str:
        """The name of a part's folder; a path may be a file in it."""
        return path.rsplit("/", 2)[1] if path.endswith(".parquet") else path.rsplit("/", 1)[1]

    def _is_mixed(self, path: str) -> bool:
        return "-of-" not in self._folder(path)

    def _rewritten(self, name: str, keys: DataFrame, new: DataFrame | None, owner: str | None) -> list[str]:
        """The parts of a table without the rows of ``keys`` (some of its columns), and with ``new``; only files that hold such rows are rewritten."""
        old = self.manifest["tables"][name]
        schema, on = schemas.PRIVATE[name], keys.columns
        able = [p for p in old if owner is None or self._is_mixed(p) or self._folder(p).endswith(self._mark(owner))]
        touched: dict[str, set[str]] = {}
        if able:
            at = self.spark.read.schema(schema).parquet(*able).select(*on, F.col("_metadata.file_path").alias("__file"))
            for (file,) in at.join(vectors.bounded(keys), on, "left_semi").select("__file").distinct().toLocalIterator():
                touched.setdefault(file.rsplit("/", 2)[1], set()).add(file.rsplit("/", 1)[1])
        out, rewrite = [], {}
        for path in old:
            folder = self._folder(path)
            if folder not in touched:
                out.append(path)
                continue
            base = path.rsplit("/", 1)[0] if path.endswith(".parquet") else path
            names = [path.rsplit("/", 1)[1]] if path.endswith(".parquet") else [n for n in self.files.names(path) if n.endswith(".parquet")]
            out += [f"{base}/{n}" for n in names if n not in touched[folder]]
            rewrite.setdefault(None if self._is_mixed(path) else owner, []).extend(f"{base}/{n}" for n in names if n in touched[folder])
        for whose, files in rewrite.items():
            rows = self.spark.read.schema(schema).parquet(*files).join(vectors.bounded(keys), on, "left_anti").select(*schema.names)
            if new is not None and whose == owner:
                rows, new = rows.unionByName(new.select(*schema.names)), None
            out += self._write(rows, name, whose)
        return out if new is None else out + self._write(new.select(*schema.names), name, owner)

    def _routed(self, name: str) -> Store:
        for role, tables in ROLES.items():
            if name in tables and role in self.bound:
                return self.bound[role]
        return self

    def table(self, name: str, owner: str | None = None) -> DataFrame:
        """A private or user table of the current snapshot; with an owner, only parts that may hold its rows."""
        if self.closed:
            raise E.ClosedHandle(self.root)
        m = self._routed(name).manifest
        if name in schemas.PRIVATE:
            paths = m["tables"][name]
            if owner is not None:
                paths = [p for p in paths if self._is_mixed(p) or self._folder(p).endswith(self._mark(owner))]
            if not paths:
                return self.spark.createDataFrame([], schemas.PRIVATE[name])
            return self.spark.read.schema(schemas.PRIVATE[name]).parquet(*paths)
        if name not in m["user_tables"]:
            raise E.InvalidArgument(f"no table {name!r}")
        return self.spark.read.parquet(*m["user_tables"][name])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in schemas.PRIVATE}

    def user_tables(self) -> list[str]:
        return sorted(self.manifest["user_tables"])

    def _change(self, changes: dict[str, tuple]) -> None:
        """Apply {table: ('append' | 'replace' | 'rewrite', rows[, owner])} as one commit, or to the open transaction.

        With an owner, ``rows`` of a replacement are all of the owner's, and the rows of others stay as they
        are.  The rows of 'rewrite' are (keys, new rows or None): rows of these keys go, new ones come.
        """
        if self.closed:
            raise E.ClosedHandle(self.root)
        if self.read_only:
            raise E.ReadOnly(self.root)
        touched: dict[int, Store] = {}
        before = {id(s): json.loads(json.dumps(s.manifest)) for s in (self, *self.bound.values())}
        for name, (how, rows, *owners) in changes.items():
            owner = owners[0] if owners else None
            home = self._routed(name)
            kind = "tables" if name in schemas.PRIVATE else "user_tables"
            old = home.manifest[kind].get(name, [])
            paths = home._rewritten(name, *rows, owner) if how == "rewrite" else home._write(rows, name, owner)
            if how == "append":
                paths = old + paths
            elif how == "replace" and owner is not None:
                mixed = [p for p in old if self._is_mixed(p)]
                paths += [p for p in old if p not in mixed and not self._folder(p).endswith(self._mark(owner))]
                if mixed:
                    others = self.spark.read.schema(schemas.PRIVATE[name]).parquet(*mixed).filter(~F.col(OWNER[name]).eqNullSafe(owner))
                    paths += home._write(others, name)
            home.manifest[kind][name] = paths
            touched[id(home)] = home
        for home in touched.values():
            if home is not self:
                role = home.manifest["role"]
                home.manifest["epoch"] += 1
                self.manifest["bound"][role]["epoch"] = home.manifest["epoch"]
        if not self.frames:
            try:
                self._commit()
            except E.Busy:
                for s in (self, *self.bound.values()):
                    s.manifest = before[id(s)]
                raise

    def _commit(self) -> None:
        for home in (*self.bound.values(), self):
            if not self.files.create(f"{home.root}/manifests/{home.number + 1:012d}.json", json.dumps(home.manifest)):
                raise E.Busy(home.root)
            home.number += 1

    def refresh(self) -> None:
        """Move the handle to the newest snapshot."""
        if self.frames:
            raise E.Misuse("a transaction is open")
        new = Store._open(self.spark, self.root, self.read_only, True)
        self.manifest, self.number, self.bound = new.manifest, new.number, new.bound

    def run(self, action: Callable[[Store], object], busy_timeout: float | None = None):
        """``action(store)``, again from the newest snapshot while another writer is first, for at most the busy timeout."""
        end = time.monotonic() + (self.busy_timeout if busy_timeout is None else busy_timeout)
        while True:
            try:
                return action(self)
            except E.Busy:
                if self.frames:
                    self.rollback()
                if time.monotonic() >= end:
                    raise
                time.sleep(0.01)
                self.refresh()

    # Transactions

    def _snapshot(self) -> dict:
        return {s.root: json.loads(json.dumps(s.manifest)) for s in (self, *self.bound.values())}

    def _restore(self, snapshot: dict) -> None:
        for s in (self, *self.bound.values()):
            s.manifest = json.loads(json.dumps(snapshot[s.root]))

    def begin(self) -> None:
        if self.frames:
            raise E.Misuse("a transaction is open")
        self.frames.append((None, self._snapshot()))
        self.hub.begin()

    begin_immediate = begin

    def commit(self) -> None:
        if not self.frames:
            raise E.Misuse("no transaction")
        self._commit()
        self.frames.clear()
        self.hub.commit()

    def rollback(self) -> None:
        if not self.frames:
            raise E.Misuse("no transaction")
        self._restore(self.frames[0][1])
        self.frames.clear()
        self.hub.rollback()

    def savepoint(self, name: str) -> None:
        self.frames.append((validate.savepoint(name), self._snapshot()))
        self.hub.begin(name)

    def _frame(self, name: str) -> int:
        for i in reversed(range(len(self.frames))):
            if self.frames[i][0] == name:
                return i
        raise E.InvalidArgument(f"no savepoint {name!r}")

    def rollback_to(self, name: str) -> None:
        at = self._frame(name)
        self._restore(self.frames[at][1])
        del self.frames[at + 1 :]
        self.hub.rollback_to(name)

    def release(self, name: str) -> None:
        del self.frames[self._frame(name) :]
        if not self.frames:
            self._commit()
        self.hub.release(name)

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Store]:
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    @contextlib.contextmanager
    def with_savepoint(self, name: str) -> Iterator[Store]:
        self.savepoint(name)
        try:
            yield self
        except BaseException:
            self.rollback_to(name)
            self.release(name)
            raise
        self.release(name)

    # Notifications

    def listen(self, channel: str) -> Subscription:
        return self.hub.listen(channel)

    def notify(self, channel: str, payload: str = "") -> int:
        return self.hub.notify(channel, payload)

    # Records

    def put_table(self, name: str, rows: DataFrame) -> None:
        """Create or replace a user table."""
        if validate.reserved(name) or name in schemas.PRIVATE:
            raise E.NameConflict(name)
        self._change({name: ("replace", rows)})

    def insert(self, name: str, rows: DataFrame, key: list[str] | None = None, on_conflict: str = "error") -> int:
        """Append rows; with a key, existing keys are an error, ignored or replaced (``error``, ``ignore``, ``update``)."""
        rows = rows.select(*self.table(name).columns)
        if key:
            old = self.table(name)
            clash = rows.join(old.select(*key), key, "left_semi")
            if on_conflict == "error":
                if clash.limit(1).count() or rows.groupBy(*key).count().filter("count > 1").limit(1).count():
                    raise E.Constraint(f"{name}: {key}")
            elif on_conflict == "ignore":
                rows = rows.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns)
            else:
                merged = old.join(rows.select(*key), key, "left_anti").select(*old.columns).unionByName(rows)
                n = rows.count()
                self._change({name: ("replace", merged)})
                return self._count(n)
        n = rows.count()
        self._change({name: ("append", rows)})
        return self._count(n)

    def update(self, name: str, where: str, values: dict[str, str]) -> int:
        """Set columns to SQL expressions in the rows that match."""
        rows = self.table(name)
        hit = F.coalesce(F.expr(where), F.lit(False))
        n = rows.filter(hit).count()
        self._change({name: ("replace", rows.select(*[F.when(hit, F.expr(values[c])).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in values else F.col(c) for c in rows.columns]))})
        return self._count(n)

    def delete_rows(self, name: str, where: str) -> int:
        rows = self.table(name)
        hit = F.coalesce(F.expr(where), F.lit(False))
        n = rows.filter(hit).count()
        self._change({name: ("replace", rows.filter(~hit))})
        return self._count(n)

    def _count(self, n: int) -> int:
        self.changes = n
        self.total_changes += n
        return n

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """A query over the user tables (as views of their names) and the private tables (with the reserved prefix).

        ``graph_walk(…)`` can stand for a table, see ``functions.sql``; ``SELECT notify(channel, payload) …`` notifies.
        """
        for name in self.manifest["user_tables"]:
            self.table(name).createOrReplaceTempView(name)
        for name in schemas.PRIVATE:
            self.table(name).createOrReplaceTempView(f"{validate.RESERVED}{name}")
        if NOTIFY.match(text):
            # One notification a row, under the rules of ``notify``; the result has a 1 for each.
            sent = [self.notify(*row[0]) for row in sql.with_walks(self.spark, NOTIFY.sub("SELECT struct(", text, count=1), self.table("graph_nodes"), self.table("graph_edges"), args).toLocalIterator()]
            return self.spark.range(len(sent)).select(F.lit(1).alias("notified"))
        return sql.with_walks(self.spark, text, self.table("graph_nodes"), self.table("graph_edges"), args)

    # Objects

    def _object_write(self) -> None:
        if self.frames and "object" not in self.bound:
            raise E.ObjectTransactionActive("object writes need a handle without a transaction")

    def put_objects(self, blobs: DataFrame, data_col: str = "data") -> None:
        """All contents of a table as objects, in one commit."""
        self._object_write()
        o, c, m = objects.put(blobs, self.table("objects"), self.table("chunks"), self.table("object_chunks"), data_col)
        self._change({"objects": ("append", o), "chunks": ("append", c), "object_chunks": ("append", m)})

    def put_object(self, data: bytes) -> bytes:
        who = scalars.object_id(data)
        self._object_write()
        if not self.has_object(who):
            self.put_objects(self.spark.createDataFrame([(bytearray(data),)], "data binary"))
        return who

    def _object(self, object_id: bytes):
        rows = self.table("objects").filter(F.col("object_id") == F.lit(bytearray(object_id))).collect()
        if not rows:
            raise E.ObjectNotFound(object_id.hex())
        return rows[0]

    def has_object(self, object_id: bytes) -> bool:
        return bool(self.table("objects").filter(F.col("object_id") == F.lit(bytearray(object_id))).limit(1).count())

    def object_size(self, object_id: bytes) -> int:
        return self._object(object_id).size_bytes

    def object_chunk_count(self, object_id: bytes) -> int:
        return self._object(object_id).chunk_count

    def _manifest(self, object_id: bytes) -> list:
        """The sound manifest of one object, in order."""
        head = self._object(object_id)
        rows = self.table("object_chunks").filter(F.col("object_id") == F.lit(bytearray(object_id))).orderBy("chunk_index").collect()
        at = 0
        for i, r in enumerate(rows):
            if r.chunk_index != i or r.offset != at or not 1 <= r.size_bytes <= fastcdc.MAX:
                raise E.ObjectCorrupt(object_id.hex())
            at += r.size_bytes
        if len(rows) != head.chunk_count or at != head.size_bytes:
            raise E.ObjectCorrupt(object_id.hex())
        return rows

    def object_manifest(self, object_id: bytes) -> list[dict]:
        rows = self._manifest(object_id)
        have = {bytes(r.chunk_hash): r.size_bytes for r in self._chunk_rows([r.chunk_hash for r in rows]).select("chunk_hash", "size_bytes").collect()}
        for r in rows:
            if have.get(bytes(r.chunk_hash)) != r.size_bytes:
                raise E.ObjectCorrupt(object_id.hex())
        return [{"index": r.chunk_index, "hash": bytes(r.chunk_hash), "offset": r.offset, "size_bytes": r.size_bytes} for r in rows]

    def _chunk_rows(self, hashes: list) -> DataFrame:
        wanted = self.spark.createDataFrame([(bytearray(h),) for h in hashes], "chunk_hash binary").distinct()
        return self.table("chunks").join(vectors.bounded(wanted), "chunk_hash", "left_semi")

    def read_object_range(self, object_id: bytes, offset: int, length: int) -> bytes:
        """At most ``length`` bytes from ``offset``; reads only the chunks that overlap."""
        head = self._object(object_id)
        if offset > head.size_bytes:
            raise E.ObjectRangeInvalid(f"{offset} of {head.size_bytes}")
        end = min(head.size_bytes, offset + length)
        if end == offset:
            return b""
        rows = [r for r in self._manifest(object_id) if r.offset + r.size_bytes > offset and r.offset < end]
        have = {bytes(r.chunk_hash): bytes(r.data) for r in self._chunk_rows([r.chunk_hash for r in rows]).collect()}
        out = []
        for r in rows:
            data = have.get(bytes(r.chunk_hash))
            if data is None or len(data) != r.size_bytes or scalars.object_id(data) != bytes(r.chunk_hash):
                raise E.ObjectCorrupt(object_id.hex())
            out.append(data[max(0, offset - r.offset) : end - r.offset])
        data = b"".join(out)
        if len(data) == head.size_bytes and scalars.object_id(data) != object_id:
            raise E.ObjectCorrupt(object_id.hex())
        return data

    def get_object(self, object_id: bytes) -> bytes:
        return self.read_object_range(object_id, 0, self._object(object_id).size_bytes)

    def has_object_chunk(self, chunk_hash: bytes) -> bool:
        return bool(self._chunk_rows([chunk_hash]).limit(1).count())

    def get_object_chunk(self, chunk_hash: bytes) -> bytes:
        rows = self._chunk_rows([chunk_hash]).collect()
        if not rows:
            raise E.ObjectChunkNotFound(chunk_hash.hex())
        data = bytes(rows[0].data)
        if len(data) != rows[0].size_bytes or scalars.object_id(data) != chunk_hash:
            raise E.ObjectCorrupt(chunk_hash.hex())
        return data

    def put_object_chunk(self, chunk_hash: bytes, data: bytes) -> None:
        if not 1 <= len(data) <= fastcdc.MAX or scalars.object_id(data) != chunk_hash:
            raise E.ObjectChunkHashMismatch(chunk_hash.hex())
        if self.has_object_chunk(chunk_hash):
            self.get_object_chunk(chunk_hash)
            return
        self._change({"chunks": ("append", self.spark.createDataFrame([(bytearray(chunk_hash), len(data), bytearray(data))], schemas.CHUNKS))})

    def delete_object_chunk(self, chunk_hash: bytes) -> bool:
        """True if the chunk was there and nothing referred to it."""
        key = F.col("chunk_hash") == F.lit(bytearray(chunk_hash))
        if not self.has_object_chunk(chunk_hash) or self.table("object_chunks").filter(key).limit(1).count():
            return False
        self._change({"chunks": ("rewrite", (self.spark.createDataFrame([(bytearray(chunk_hash),)], "chunk_hash binary"), None))})
        return True

    def assemble_object(self, object_id: bytes, size_bytes: int, chunks: list[dict]) -> None:
        """An object from stored chunks; ``chunks`` (index, hash, offset, size_bytes) come in any order."""
        self._object_write()
        chunks = sorted(chunks, key=lambda c: c["index"])
        at = 0
        for i, c in enumerate(chunks):
            if c["index"] != i or c["offset"] != at or not 1 <= c["size_bytes"] <= fastcdc.MAX:
                raise E.ObjectManifestInvalid(object_id.hex())
            at += c["size_bytes"]
        if at != size_bytes:
            raise E.ObjectManifestInvalid(object_id.hex())
        have = {bytes(r.chunk_hash): bytes(r.data) for r in self._chunk_rows([c["hash"] for c in chunks]).collect()}
        for c in chunks:
            if c["hash"] not in have:
                raise E.ObjectChunkNotFound(c["hash"].hex())
            if len(have[c["hash"]]) != c["size_bytes"]:
                raise E.ObjectManifestInvalid(object_id.hex())
        if scalars.object_id(b"".join(have[c["hash"]] for c in chunks)) != object_id:
            raise E.ObjectManifestInvalid(object_id.hex())
        if self.has_object(object_id):
            raise E.ObjectAlreadyExists(object_id.hex())
        rows = [(bytearray(object_id), c["index"], bytearray(c["hash"]), c["offset"], c["size_bytes"]) for c in chunks]
        self._change({
            "objects": ("append", self.spark.createDataFrame([(bytearray(object_id), size_bytes, len(chunks), fastcdc.CHUNKER)], schemas.OBJECTS)),
            "object_chunks": ("append", self.spark.createDataFrame(rows, schemas.OBJECT_CHUNKS)),
        })

    def delete_object(self, object_id: bytes) -> None:
        self._object_write()
        self._object(object_id)
        gone = self.spark.createDataFrame([(bytearray(object_id),)], "object_id binary")
        dead = objects.dead_chunks(self.table("object_chunks"), gone)
        self._change({"objects": ("rewrite", (gone, None)), "chunks": ("rewrite", (dead, None)), "object_chunks": ("rewrite", (gone, None))})

    def object_writer(self):
        from stratalode.streaming.object_writer import ObjectWriter

        return ObjectWriter(self)

    # Vectors

    def create_vector_collection(self, name: str, dimensions: int, metric: str) -> None:
        row = (validate.collection_name(name), validate.dimensions(dimensions), validate.metric(metric), "f32")
        if self.has_vector_collection(name):
            raise E.VectorCollectionExists(name)
        self._change({"vector_collections": ("append", self.spark.createDataFrame([row], schemas.VECTOR_COLLECTIONS))})

    def has_vector_collection(self, name: str) -> bool:
        validate.collection_name(name)
        return bool(self.table("vector_collections").filter(F.col("name") == name).limit(1).count())

    def _collection(self, name: str):
        validate.collection_name(name)
        rows = self.table("vector_collections").filter(F.col("name") == name).collect()
        if not rows:
            raise E.VectorCollectionNotFound(name)
        return rows[0]

    def _vectors(self, name: str) -> DataFrame:
        return self.table("vectors", name).filter(F.col("collection_name") == name)

    def vector_collection_info(self, name: str) -> dict:
        c = self._collection(name)
        return {"name": name, "dimensions": c.dimensions, "metric": c.metric, "element_type": c.element_type, "vector_count": self._vectors(name).count()}

    def list_vector_collections(self) -> DataFrame:
        return vectors.collection_info(self.table("vector_collections"), self.table("vectors")).orderBy("name")

    def put_vector(self, collection: str, vector_id: str, values: list[float]) -> None:
        self.put_vectors(collection, [(vector_id, values)])

    def put_vectors(self, collection: str, rows: list[tuple[str, list[float]]]) -> None:
        """All rows or none; of one id the last row counts."""
        c = self._collection(collection)
        checked = {validate.vector_id(i): validate.values(v, c.dimensions, c.metric) for i, v in rows}
        self.put_vector_rows(collection, self.spark.createDataFrame([(i, v) for i, v in checked.items()], "vector_id string, values array<float>"))

    def put_vector_rows(self, collection: str, rows: DataFrame) -> None:
        """Rows (vector_id, values), one an id; a damaged row fails the whole call."""
        c = self._collection(collection)
        new = rows.select(F.lit(collection).alias("collection_name"), "vector_id", F.lit(c.dimensions).alias("dimensions"), F.col("values").cast("array<float>").alias("values"))
        if diagnose.unsound_vectors(self.table("vector_collections"), new).limit(1).count():
            raise E.VectorInvalid(f"rows that do not fit {collection!r}")
        old, new = self._vectors(collection), new.select(*schemas.VECTORS.names)
        if old.join(new.select("vector_id"), "vector_id", "left_semi").limit(1).count():
            self._change({"vectors": ("rewrite", (new.select("collection_name", "vector_id"), new), collection)})
        else:
            self._change({"vectors": ("append", new, collection)})

    def get_vector(self, collection: str, vector_id: str) -> list[float]:
        c = self._collection(collection)
        validate.vector_id(vector_id)
        rows = self._vectors(collection).filter(F.col("vector_id") == vector_id).collect()
        if not rows:
            raise E.VectorNotFound(vector_id)
        try:
            return validate.values(rows[0]["values"], c.dimensions, c.metric)
        except E.StoreError as e:
            raise E.VectorCorrupt(vector_id) from e

    def has_vector(self, collection: str, vector_id: str) -> bool:
        self._collection(collection)
        validate.vector_id(vector_id)
        return bool(self._vectors(collection).filter(F.col("vector_id") == vector_id).limit(1).count())

    def delete_vector(self, collection: str, vector_id: str) -> None:
        if not self.has_vector(collection, vector_id):
            raise E.VectorNotFound(vector_id)
        self._change({"vectors": ("rewrite", (self.spark.createDataFrame([(collection, vector_id)], "collection_name string, vector_id string"), None), collection)})

    def delete_vector_collection(self, name: str) -> None:
        self._collection(name)
        self._change({"vectors": ("replace", self.spark.createDataFrame([], schemas.VECTORS), name), "vector_collections": ("replace", self.table("vector_collections").filter(F.col("name") != name))})

    def search_vectors(self, collection: str, query: list[float] | None = None, limit: int | None = 10, max_distance: float | None = None, candidates: list[str] | DataFrame | None = None, source_id: str | None = None) -> DataFrame:
        """Nearest vectors to a query or to a stored vector (left out itself); see ``operators.vectors.search``."""
        c = self._collection(collection)
        if (query is None) == (source_id is None):
            raise E.VectorInvalid("give a query or a source_id")
        if isinstance(candidates, list):
            candidates = self.spark.createDataFrame([(validate.vector_id(x),) for x in candidates], "vector_id string")
        q = validate.values(query, c.dimensions, c.metric) if query is not None else self.get_vector(collection, source_id)
        return vectors.search(self._vectors(collection), q, c.metric, limit, max_distance, candidates, source_id)

    # Graphs

    def _next(self, name: str, graph_name: str | None = None) -> int:
        """The next order: of graphs, or of nodes or edges inside one graph."""
        rows = self.table(name) if graph_name is None else self._rows(name, graph_name)
        return (rows.agg(F.max("created_order")).first()[0] or 0) + 1

    def create_graph(self, name: str = DEFAULT_GRAPH) -> None:
        if self.has_graph(name):
            raise E.GraphExists(name)
        self._change({"graphs": ("append", self.spark.createDataFrame([(name, self._next("graphs"))], schemas.GRAPHS))})

    def has_graph(self, name: str = DEFAULT_GRAPH) -> bool:
        validate.graph_name(name)
        return bool(self.table("graphs").filter(F.col("name") == name).limit(1).count())

    def _graph(self, name: str) -> None:
        if not self.has_graph(name):
            raise E.GraphNotFound(name)

    def _rows(self, table: str, graph_name: str) -> DataFrame:
        return self.table(table, graph_name).filter(F.col("graph_name") == graph_name)

    def delete_graph(self, name: str = DEFAULT_GRAPH) -> None:
        self._graph(name)
        self._change({
            "graph_edges": ("replace", self.spark.createDataFrame([], schemas.GRAPH_EDGES), name),
            "graph_nodes": ("replace", self.spark.createDataFrame([], schemas.GRAPH_NODES), name),
            "graphs": ("replace", self.table("graphs").filter(F.col("name") != name)),
        })

    def graph_info(self, name: str = DEFAULT_GRAPH) -> dict:
        self._graph(name)
        return graph.info(self.table("graphs").filter(F.col("name") == name), self._rows("graph_nodes", name), self._rows("graph_edges", name)).first().asDict()

    def list_graphs(self) -> DataFrame:
        return graph.info(self.table("graphs"), self.table("graph_nodes"), self.table("graph_edges")).orderBy("name")

    def put_graph_node(self, node_id: str, kind: str, graph_name: str = DEFAULT_GRAPH, target_type: str = "none", target_namespace: str | None = None, target_ref: str | None = None) -> None:
        """Insert or replace a node; a node that is there keeps its order."""
        validate.node_id(node_id)
        validate.kind(kind)
        validate.target(target_type, target_namespace, target_ref)
        self._graph(graph_name)
        hit = F.col("node_id") == node_id
        old = self._rows("graph_nodes", graph_name).filter(hit).collect()
        row = (graph_name, node_id, kind, target_type, target_namespace, target_ref, old[0].created_order if old else self._next("graph_nodes", graph_name))
        new = self.spark.createDataFrame([row], schemas.GRAPH_NODES)
        self._change({"graph_nodes": ("rewrite", (new.select("graph_name", "node_id"), new), graph_name) if old else ("append", new, graph_name)})

    def get_graph_node(self, node_id: str, graph_name: str = DEFAULT_GRAPH) -> dict:
        validate.graph_name(graph_name)
        validate.node_id(node_id)
        rows = self._rows("graph_nodes", graph_name).filter(F.col("node_id") == node_id).collect()
        if not rows:
            raise E.GraphNodeNotFound(node_id)
        return rows[0].asDict()

    def has_graph_node(self, node_id: str, graph_name: str = DEFAULT_GRAPH) -> bool:
        try:
            self.get_graph_node(node_id, graph_name)
        except E.GraphNodeNotFound:
            return False
        return True

    def delete_graph_node(self, node_id: str, graph_name: str = DEFAULT_GRAPH) -> None:
        self.get_graph_node(node_id, graph_name)
        node = self.spark.createDataFrame([(graph_name, node_id)], "graph_name string, node_id string")
        edges = self._rows("graph_edges", graph_name).filter((F.col("from_node_id") == node_id) | (F.col("to_node_id") == node_id)).select(*EDGE)
        self._change({"graph_nodes": ("rewrite", (node, None), graph_name), "graph_edges": ("rewrite", (edges, None), graph_name)})

    def _edge(self, from_id: str, edge_type: str, to_id: str, graph_name: str):
        validate.graph_name(graph_name)
        validate.edge_type(edge_type)
        return (F.col("graph_name") == graph_name) & (F.col("from_node_id") == validate.node_id(from_id)) & (F.col("edge_type") == edge_type) & (F.col("to_node_id") == validate.node_id(to_id))

    def put_graph_edge(self, from_id: str, edge_type: str, to_id: str, graph_name: str = DEFAULT_GRAPH) -> None:
        """Insert an edge between nodes that are there; an edge that is there stays as it is."""
        hit = self._edge(from_id, edge_type, to_id, graph_name)
        self._graph(graph_name)
        self.get_graph_node(from_id, graph_name)
        self.get_graph_node(to_id, graph_name)
        if not self._rows("graph_edges", graph_name).filter(hit).limit(1).count():
            self._change({"graph_edges": ("append", self.spark.createDataFrame([(graph_name, from_id, edge_type, to_id, self._next("graph_edges", graph_name))], schemas.GRAPH_EDGES), graph_name)})

    def get_graph_edge(self, from_id: str, edge_type: str, to_id: str, graph_name: str = DEFAULT_GRAPH) -> dict:
        rows = self._rows("graph_edges", graph_name).filter(self._edge(from_id, edge_type, to_id, graph_name)).collect()
        if not rows:
            raise E.GraphEdgeNotFound(f"{from_id} {edge_type} {to_id}")
        return rows[0].asDict()

    def has_graph_edge(self, from_id: str, edge_type: str, to_id: str, graph_name: str = DEFAULT_GRAPH) -> bool:
        return bool(self._rows("graph_edges", graph_name).filter(self._edge(from_id, edge_type, to_id, graph_name)).limit(1).count())

    def delete_graph_edge(self, from_id: str, edge_type: str, to_id: str, graph_name: str = DEFAULT_GRAPH) -> None:
        self.get_graph_edge(from_id, edge_type, to_id, graph_name)
        edge = self.spark.createDataFrame([(graph_name, from_id, edge_type, to_id)], ", ".join(f"{c} string" for c in EDGE))
        self._change({"graph_edges": ("rewrite", (edge, None), graph_name)})

    def put_graph_rows(self, nodes: DataFrame, edges: DataFrame, graph_name: str | None = None) -> None:
        """Many nodes and edges at once, with their orders; say the graph if they are all of one.

        All or none: graphs and ends of edges must be there, nodes and edges must be new and come once.
        """
        for rows, table, key, wrong in ((nodes, "graph_nodes", NODE, E.Constraint), (edges, "graph_edges", EDGE, E.Constraint)):
            if graph_name is not None and rows.filter(~F.col("graph_name").eqNullSafe(graph_name)).limit(1).count():
                raise E.GraphNotFound(f"rows that are not of {graph_name!r}")
            old = self.table(table) if graph_name is None else self._rows(table, graph_name)
            if rows.groupBy(*key).count().filter("count > 1").limit(1).count() or rows.join(old, key, "left_semi").limit(1).count():
                raise wrong(f"{table}: {key}")
            if rows.join(self.table("graphs").select(F.col("name").alias("graph_name")), "graph_name", "left_anti").limit(1).count():
                raise E.GraphNotFound(table)
        known = nodes.select(*NODE).unionByName((self.table("graph_nodes") if graph_name is None else self._rows("graph_nodes", graph_name)).select(*NODE))
        ends = edges.select("graph_name", F.explode(F.array("from_node_id", "to_node_id")).alias("node_id"))
        if ends.join(known, NODE, "left_anti").limit(1).count():
            raise E.GraphNodeNotFound("an end of an edge")
        self._change({"graph_nodes": ("append", nodes.select(*schemas.GRAPH_NODES.names), graph_name), "graph_edges": ("append", edges.select(*schemas.GRAPH_EDGES.names), graph_name)})

    def graph_neighbors(self, node_id: str, graph_name: str = DEFAULT_GRAPH, direction: str = "outgoing", edge_type: str | None = None, limit: int = 10) -> DataFrame:
        return graph.neighbors(self._rows("graph_nodes", graph_name), self._rows("graph_edges", graph_name), graph_name, node_id, direction, edge_type, limit)

    def graph_walk(self, start: str, graph_name: str = DEFAULT_GRAPH, max_depth: int = 1, edge_type: str | None = None, limit: int = 10) -> DataFrame:
        return graph.walk(self._rows("graph_nodes", graph_name), self._rows("graph_edges", graph_name), graph_name, start, max_depth, edge_type, limit)

    # Bound stores

    def bind_store(self, role: str, path: str, create: bool = True) -> None:
        """Route the role's tables to another store; the main ones must be empty."""
        if role not in ROLES or role in self.bound:
            raise E.BoundStoreExists(role) if role in self.bound else E.InvalidArgument(role)
        if any(self.table(t).limit(1).count() for t in ROLES[role]):
            raise E.BoundStoreExists(f"main {role} tables are not empty")
        other = Store.create(self.spark, path, role) if create else Store.open(self.spark, path, load_bound=False)
        if other.manifest["role"] != role:
            raise E.BoundStoreInvalid(path)
        other.manifest["bound_set_id"], other.manifest["epoch"] = uuid.uuid4().hex, 0
        self.manifest["bound"][role] = {"path": other.root, "store_id": other.manifest["store_id"], "bound_set_id": other.manifest["bound_set_id"], "epoch": 0, "created_at_unix": int(time.time())}
        self.bound[role] = other
        if not self.frames:
            self._commit()

    def split_store(self, role: str, path: str) -> dict[str, int]:
        """Move the role's rows to a new bound store; the numbers of rows moved."""
        rows = {t: self.table(t) for t in ROLES[role]}
        counts = {t: df.count() for t, df in rows.items()}
        with self.transaction() if not self.frames else contextlib.nullcontext():
            for t in rows:
                self._change({t: ("replace", self.spark.createDataFrame([], schemas.PRIVATE[t]))})
            self.bind_store(role, path)
            self._change({t: ("replace", df) for t, df in rows.items()})
        return counts

    def unbind_store(self, role: str) -> None:
        """Forget a bound store; its files stay as they are."""
        if role not in self.bound:
            raise E.BoundStoreNotFound(role)
        del self.bound[role], self.manifest["bound"][role]
        if not self.frames:
            self._commit()

    # Copies

    def _copy(self, path: str, write: Callable[[DataFrame], DataFrame], verify: bool) -> Store:
        if Files(self.spark).exists(path):
            raise E.DestinationExists(path)
        out = Store.create(self.spark, path)
        changes = {name: ("replace", write(df)) for name, df in self.tables().items()}
        changes |= {name: ("replace", write(self.table(name))) for name in self.user_tables()}
        out._change(changes)
        if verify and out.issues().filter(F.col("area") != "graph").limit(1).count():
            raise E.Corrupt(path)
        return out

    def backup(self, path: str, verify: bool = True) -> Store:
        """A copy of this snapshot, bound stores inlined."""
        return self._copy(path, lambda df: df, verify)

    def compact(self, path: str, verify: bool = True) -> Store:
        """A copy whose files are merged to sizes that suit the data."""
        return self._copy(path, lambda df: df.hint("rebalance"), verify)

    def vacuum(self) -> None:
        """Rewrite tables of several parts, and drop data and manifests that this snapshot does not use."""
        if self.frames:
            raise E.Misuse("no vacuum in a transaction")
        if self.manifest["role"] != "main":
            raise E.Misuse("a bound store's snapshot is the one that its main store names")
        many = [n for n, paths in {**self.manifest["tables"], **self.manifest["user_tables"]}.items() if len(paths) > 1 and self._routed(n) is self]
        for name in many:
            if name in OWNER:  # parts of one owner are merged with each other only
                for (owner,) in self.table(name).select(OWNER[name]).distinct().toLocalIterator():
                    own = self.table(name, owner).filter(F.col(OWNER[name]) == owner)
                    self._change({name: ("replace", own.hint("rebalance"), owner)})
            else:
                self._change({name: ("replace", self.table(name).hint("rebalance"))})
        used = {self._folder(p) for paths in (*self.manifest["tables"].values(), *self.manifest["user_tables"].values()) for p in paths}
        for name in self.files.names(f"{self.root}/data"):
            if name not in used:
                self.files.remove(f"{self.root}/data/{name}")
        for name in self.files.names(f"{self.root}/manifests")[:-1]:
            self.files.remove(f"{self.root}/manifests/{name}")

    # Inspection

    def issues(self, deep: bool = True) -> DataFrame:
        return diagnose.all_issues(self.tables(), deep)

    def summary(self) -> dict[str, int]:
        counts = {name: df.count() for name, df in self.tables().items()}
        loose = objects.loose_chunks(self.table("chunks"), self.table("object_chunks")).count()
        return {"user_tables": len(self.user_tables()), **counts, "loose_chunks": loose}

    def object_stats(self) -> dict:
        return objects.stats(self.table("objects"), self.table("chunks"), self.table("object_chunks")).first().asDict()

    def check(self, deep: bool = False, limit: int = 10) -> dict:
        """Counts of issues by area, and the first ``limit`` (at most 100)."""
        found = self.issues(deep)
        counts = {r.area: r["count"] for r in found.groupBy("area").count().collect()}
        return {"ok": not counts, "issue_counts": counts, "issues": [r.asDict() for r in found.orderBy("area", "kind", *diagnose.COLUMNS).limit(min(limit, 100)).collect()], "truncated": sum(counts.values()) > limit}

    def doctor(self, limit: int = 10) -> dict:
        """Summary, issues and what to do about them."""
        report = self.check(deep=True, limit=limit)
        advice = {"object": "salvage into a new store; damaged objects are left out", "chunk": "put the missing chunks again, or salvage", "vector": "put the damaged vectors again, or salvage", "graph": "put the missing targets or nodes, or salvage"}
        return {"summary": self.summary(), **report, "suggestions": [advice[a] for a in sorted(report["issue_counts"]) if a in advice]}

    def list_objects(self, limit: int = inspect.DEFAULT) -> dict:
        return inspect.list_objects(self.table("objects"), limit)

    def inspect_object(self, object_id: bytes, limit: int = inspect.DEFAULT) -> dict:
        return inspect.object_detail(self.table("objects"), self.table("object_chunks"), self.table("chunks"), object_id, limit)

    def list_chunks(self, limit: int = inspect.DEFAULT) -> dict:
        return inspect.list_chunks(self.table("chunks"), self.table("object_chunks"), limit)

    def inspect_chunk(self, chunk_hash: bytes, limit: int = inspect.DEFAULT) -> dict:
        return inspect.chunk_detail(self.table("chunks"), self.table("object_chunks"), chunk_hash, limit)

    def list_vectors(self, collection: str, limit: int = inspect.DEFAULT) -> dict:
        self._collection(collection)
        return inspect.list_vectors(self.table("vectors"), collection, limit)

    def list_graph_nodes(self, graph_name: str = DEFAULT_GRAPH, limit: int = inspect.DEFAULT) -> dict:
        self._graph(graph_name)
        return inspect.list_nodes(self.table("graph_nodes"), graph_name, limit)

    def table_columns(self, name: str) -> list[dict]:
        return inspect.table_columns(self.table(name))

    def salvage_plan(self) -> dict:
        return diagnose.salvage_plan(self.summary(), self.check(deep=True)["issue_counts"])

    def salvage(self, path: str) -> Store:
        """A new store with the sound rows of this one."""
        if Files(self.spark).exists(path):
            raise E.DestinationExists(path)
        rows = diagnose.salvaged(self.tables())
        out = Store.create(self.spark, path)
        out._change({**{name: ("replace", df) for name, df in rows.items()}, **{name: ("replace", self.table(name)) for name in self.user_tables()}})
        return out


def restore(spark: SparkSession, backup: str, path: str, verify: bool = True) -> Store:
    return Store.open(spark, backup, read_only=True).backup(path, verify)


def convert(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> Store:
    """A new store with plain tables as its user tables; reserved names are refused first."""
    for name in tables:
        if validate.reserved(name) or name in schemas.PRIVATE:
            raise E.NameConflict(name)
    out = Store.create(spark, path)
    if tables:
        out._change({name: ("replace", df) for name, df in tables.items()})
    return out


def numbered(df: DataFrame, by: list[str], start: int = 1) -> DataFrame:
    """``created_order`` for a bulk load that is partitioned by graph."""
    return df.withColumn("created_order", (F.row_number().over(Window.partitionBy("graph_name").orderBy(*by)) + start - 1).cast("long"))
