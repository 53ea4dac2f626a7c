"""Scalar functions: content ids, little-endian float codecs, hex ids, distances."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalode import errors as E


def object_id(data: bytes) -> bytes:
    """SHA-256 of all bytes; chunk ids are made alike."""
    return hashlib.sha256(data).digest()


object_chunk_id = object_id


def content_id(data: Column) -> Column:
    """SHA-256 of a binary column, as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def hex_id(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def parse_hex_id(text: str) -> bytes:
    """32 bytes from 64 hex digits in either case."""
    if not re.fullmatch(r"[0-9A-Fa-f]{64}", text):
        raise E.InvalidArgument(f"not a 32-byte hex id: {text!r}")
    return bytes.fromhex(text)


def encode_f32_le(values: Iterable[float]) -> bytes:
    v = list(values)
    return struct.pack(f"<{len(v)}f", *v)


def decode_f32_le(data: bytes, dims: int) -> list[float]:
    if len(data) != 4 * dims:
        raise E.VectorCorrupt(f"{len(data)} bytes, {dims} dimensions")
    out = list(struct.unpack(f"<{dims}f", data))
    if any(x != x or x in (float("inf"), float("-inf")) for x in out):
        raise E.VectorCorrupt("a value is not finite")
    return out


@F.pandas_udf(T.BinaryType())
def encode_f32(values: pd.Series) -> pd.Series:
    """ARRAY<FLOAT> to little-endian bytes; null stays null."""
    import numpy as np

    return values.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(data: pd.Series) -> pd.Series:
    """Little-endian bytes to ARRAY<FLOAT>; null where the length does not divide by 4."""
    import numpy as np

    return data.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))


def _dot(a: Column, b: Column) -> Column:
    """Sum of products in double, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(metric: str, query: Column, vector: Column) -> Column:
    """Distance of two ARRAY<FLOAT> columns, accumulated in double from left to right; lower is nearer.

    A cosine with a zero norm is NaN.
    """
    if metric == "dot":
        return -_dot(query, vector)
    if metric == "l2":
        square = F.zip_with(query, vector, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))
    norms = F.sqrt(_dot(query, query)) * F.sqrt(_dot(vector, vector))
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - _dot(query, vector) / norms)
