"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a tree hold, for each position of a pre-token, the key
``rank * 2**20 + position`` of the pair that starts there; an inner node holds
the least key below it.  So the root names the leftmost pair of the lowest
rank.  A merge rewrites three leaves (the merged pair, its left neighbour, and
the symbol that vanished) and the paths above them, until the root is empty.

Short pre-tokens of one length class go through the same trees together, as the
rows of one array; a long one gets a tree of its own.  Distinct pre-tokens are
encoded once per task, in a table of bounded size.

Defined results: null and empty texts have no ids and decode to ""; repeated
rows give repeated results; a text of any length is encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalode.llm.runtime import gather, map_text

NONE = np.int64(2**62)
SHIFT, MASK = 20, 2**20 - 1
#: Pre-tokens of more bytes get a tree of their own.
TOGETHER = 64
#: Distinct chunks that a task remembers before it starts anew.
REMEMBERED = 200_000
#: The published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode White_Space, as the pattern's \s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A text falls into these chunks, and no pre-token crosses from one to the next.
CHUNK = re.compile(f"[{SPACE}]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    """Vocabulary, merge ranks and special strings of a tokenizer file, from its bytes."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[s] for s in symbols], dtype=np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=lambda x: -len(x))) + ")") if self.special else None
        code = {s: b for b, s in enumerate(symbols)}
        pieces = {i: bytes(code[c] for c in s) for s, i in vocab.items()}
        pieces |= {i: s.encode() for s, i in self.special.items()}
        self.lens = np.array([len(pieces.get(i, b"")) for i in range(max(pieces) + 1)], dtype=np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(len(self.lens))), dtype=np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it cannot be merged or a side is -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.key_ranks[at], NONE)

    def merge_rows(self, rows: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of byte symbols (padded by -1) in one array of segment trees; flat ids and their counts."""
        count, size = rows.shape
        tok = np.full((count, size + 2), -1, dtype=np.int64)  # column `size` ends a row, the last precedes it
        tok[:, :size] = rows
        nxt = np.minimum(np.arange(1, size + 3), size) * np.ones((count, 1), dtype=np.int64)
        nxt = np.where(nxt < lens[:, None], nxt, size)
        prv = np.arange(-1, size + 1) * np.ones((count, 1), dtype=np.int64)
        prv[:, 0] = size + 1
        tree = np.full((count, 2 * size), NONE)
        rank = self.ranks(tok[:, : size - 1].ravel(), tok[:, 1:size].ravel()).reshape(count, size - 1)
        tree[:, size : 2 * size - 1] = np.where(rank < NONE, rank << SHIFT | np.arange(size - 1), NONE)
        half = size
        while half > 1:
            np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2], out=tree[:, half // 2 : half])
            half //= 2
        tok_, nxt_, prv_, tree_ = tok.ravel(), nxt.ravel(), prv.ravel(), tree.ravel()
        live = np.flatnonzero(tree[:, 1] < NONE)
        while live.size:
            row, at = live * (size + 2), live * (2 * size)
            root = tree_[at + 1]
            i = root & MASK
            j = nxt_[row + i]
            k = nxt_[row + j]
            p = prv_[row + i]
            new = self.merged[root >> SHIFT]
            tok_[row + i], nxt_[row + i], prv_[row + k] = new, k, i
            tok_[row + j] = -1
            tree_[at + size + j] = NONE
            rank = self.ranks(new, tok_[row + k])
            tree_[at + size + i] = np.where(rank < NONE, rank << SHIFT | i, NONE)
            rank = self.ranks(tok_[row + p], new)
            q = np.where(p < size, p, j)
            tree_[at + size + q] = np.where((p < size) & (rank < NONE), rank << SHIFT | q, NONE)
            for leaf in (j, i, q):
                node = leaf + size >> 1
                while node[0]:  # all leaves have one depth
                    tree_[at + node] = np.minimum(tree_[at + 2 * node], tree_[at + 2 * node + 1])
                    node = node >> 1
            live = live[tree_[at + 1] < NONE]
        left = tok[:, :size] >= 0
        return tok[:, :size][left], left.sum(axis=1)

    def merge_one(self, data: bytes) -> list[int]:
        """The ids of one pre-token of any length, from a segment tree of its own."""
        tok = self.byte_ids[np.frombuffer(data, dtype=np.uint8)].tolist()
        n = len(tok)
        size = 1 << max(1, (n - 1).bit_length())
        shift = size.bit_length()
        none, mask, ranks, merged = 1 << 62, (1 << shift) - 1, self.rank_of, self.merged.tolist()
        tree = [none] * (2 * size)

        def key(at: int, a: int, b: int) -> int:
            r = ranks.get(a << 32 | b)
            return none if r is None else r << shift | at

        for i in range(n - 1):
            tree[size + i] = key(i, tok[i], tok[i + 1])
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n))
        while (root := tree[1]) < none:
            i = root & mask
            j = nxt[i]
            k = nxt[j]
            tok[i], tok[j], nxt[i] = merged[root >> shift], -1, k
            prv[k] = i
            tree[size + j] = none
            tree[size + i] = key(i, tok[i], tok[k]) if k < n else none
            changed = [j, i]
            if (p := prv[i]) >= 0:
                tree[size + p] = key(p, tok[p], tok[i])
                changed.append(p)
            for leaf in changed:
                node = size + leaf >> 1
                while node:
                    tree[node] = min(tree[2 * node], tree[2 * node + 1])
                    node >>= 1
        return [t for t in tok if t >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pre-tokens, in their order, and how many each has."""
        lens = np.array([len(p) for p in pieces], dtype=np.int64)
        counts = np.zeros(len(pieces), dtype=np.int64)
        flats, order = [], []
        size = 2
        while size <= TOGETHER:
            at = np.flatnonzero((lens <= size) & (lens > (size // 2 if size > 2 else 0)))
            for part in (at[i : i + 5_000] for i in range(0, len(at), 5_000)):
                data = np.frombuffer(b"".join(pieces[i] for i in part.tolist()), dtype=np.uint8)
                rows = np.full((len(part), size), -1, dtype=np.int64)
                rows[np.arange(size) < lens[part][:, None]] = self.byte_ids[data]
                flat, n = self.merge_rows(rows, lens[part])
                counts[part] = n
                flats.append(flat)
                order.append(part)
            size *= 2
        for i in np.flatnonzero(lens > TOGETHER).tolist():
            ids = self.merge_one(pieces[i])
            counts[i] = len(ids)
            flats.append(np.array(ids, dtype=np.int64))
            order.append(np.array([i]))
        if not order:
            return np.zeros(0, dtype=np.int64), counts
        made = np.concatenate(order)
        starts = np.zeros(len(pieces), dtype=np.int64)
        starts[made] = np.cumsum(counts[made]) - counts[made]
        return gather(np.concatenate(flats), starts, counts), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of consecutive runs of ids; special ids give their strings."""
        data = gather(self.bytes, self.starts[ids], self.lens[ids]).tobytes()
        ends = np.r_[0, np.cumsum(self.lens[ids])][np.cumsum(counts)].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Table:
    """Strings with their ids: a dictionary over one growing array."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.starts, self.lens = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def add(self, names: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        n, m = len(self.index), len(names)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + m > len(self.lens):
            self.starts, self.lens = np.r_[self.starts, np.zeros_like(self.starts)], np.r_[self.lens, np.zeros_like(self.lens)]
        self.flat[self.used : self.used + len(flat)] = flat
        self.lens[n : n + m] = lens
        self.starts[n : n + m] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        self.index.update(zip(names, range(n, n + m), strict=True))

    def take(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.index.__getitem__, names), dtype=np.int64, count=len(names))
        return gather(self.flat, self.starts[at], self.lens[at]), self.lens[at]


class Encoder:
    """Encodes texts with remembered chunks and pre-tokens; at most about ``remembered`` of each."""

    def __init__(self, bpe: Bpe, remembered: int = REMEMBERED):
        self.bpe, self.remembered = bpe, remembered
        self.pieces = regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.chunk_table, self.piece_table = Table(), Table()
        for s, i in self.bpe.special.items():
            self.chunk_table.add([s], np.array([i]), np.array([1]))

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text, special strings standing alone, some hundred thousand at a time."""
        for part in self.bpe.split.split(text) if self.bpe.split and any(s in text for s in self.bpe.special) else [text]:
            if part in self.bpe.special:
                yield [part]
            elif len(part) < 1_000_000:
                yield CHUNK.findall(part)
            else:
                found = (m.group() for m in CHUNK.finditer(part))
                while some := list(islice(found, 200_000)):
                    yield some

    def known(self, chunks: list[str]) -> None:
        new = list(set(chunks).difference(self.chunk_table.index))
        if not new:
            return
        split = [self.pieces(c) for c in new]
        flat = [p for ps in split for p in ps]
        if fresh := list(set(flat).difference(self.piece_table.index)):
            self.piece_table.add(fresh, *self.bpe.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh]))
        ids, lens = self.piece_table.take(flat)
        ends = np.cumsum([len(ps) for ps in split])
        sums = np.r_[0, np.cumsum(lens)][ends]
        self.chunk_table.add(new, ids, np.diff(np.r_[0, sums]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (int32) of the texts and how many each has."""
        counts, flats, held, sizes = np.zeros(len(texts), dtype=np.int64), [], [], []

        def flush() -> None:
            if len(self.chunk_table.index) > self.remembered:
                self.clear()
            self.known(held)
            ids, lens = self.chunk_table.take(held)
            owner = np.repeat([k for k, _ in sizes], [n for _, n in sizes])
            np.add.at(counts, owner, lens)
            flats.append(ids)
            held.clear()
            sizes.clear()

        for k, text in enumerate(texts):
            for some in self.chunks(text):
                held.extend(some)
                sizes.append((k, len(some)))
                if len(held) >= 100_000:
                    flush()
        if held:
            flush()
        return np.concatenate(flats) if flats else np.zeros(0, dtype=np.int32), counts


def _model(spark, path: str) -> Callable[[], Bpe]:
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # one vocabulary file, a few MB
    return lambda: Bpe(shared.value)


def _ids(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids_col`` array<int>."""
    load = _model(docs.sparkSession, model_path)

    def make():
        encoder = Encoder(load())
        return lambda texts: [_ids(*encoder.encode(texts))]

    return map_text(docs, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make, text_col)


def decode(ids: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns of ``ids`` and the text of ``ids_col``; null ids decode to ""."""
    load = _model(ids.sparkSession, model_path)
    names = [f.name for f in ids.schema.fields if f.name != text_col]

    def run(batches):
        bpe = load()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                column = part.column(part.schema.get_field_index(ids_col))
                counts = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
                flat = np.asarray(column.flatten(), dtype=np.int64)
                texts = bpe.decode(flat, counts)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in names], pa.array(texts, pa.string())], names=[*names, text_col])

    kept = [f for f in ids.schema.fields if f.name != text_col]
    return ids.select(*[f"`{n}`" for n in names]).mapInArrow(run, T.StructType([*kept, T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, ``ids`` and ``decoded``, the text that the ids decode to, in one pass."""
    load = _model(docs.sparkSession, model_path)

    def make():
        bpe = load()
        encoder = Encoder(bpe)

        def work(texts: list[str]) -> list:
            flat, counts = encoder.encode(texts)
            return [_ids(flat, counts), pa.array(bpe.decode(flat, counts), pa.string())]

        return work

    return map_text(docs, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], make, text_col)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``round_trip`` returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
