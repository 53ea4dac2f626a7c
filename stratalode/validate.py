"""Rules for names, values and sizes, checked on the driver before any job runs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from stratalode import errors as E

RESERVED = "_stratalode_"
MAX_DIMENSIONS = 16_384
MAX_CHUNK = 65_536
METRICS = ("cosine", "l2", "dot")
DIRECTIONS = ("outgoing", "incoming")
TARGET_TYPES = ("none", "record", "object", "object_chunk", "vector", "entity", "fact", "concept", "external")
OWNED_TARGETS = ("object", "object_chunk", "vector")
SYMBOL = r"[A-Za-z0-9_.:-]{1,128}"
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}\Z")
MAX_I64 = 2**63 - 1


def reserved(name: str) -> bool:
    return name.lower().startswith(RESERVED)


def _utf8(value: str, error: type[Exception]) -> bytes:
    try:
        return value.encode("utf-8")
    except (UnicodeEncodeError, AttributeError) as e:
        raise error(f"not UTF-8 text: {value!r}") from e


def collection_name(name: str) -> str:
    if not 1 <= len(_utf8(name, E.VectorInvalid)) <= 255 or reserved(name):
        raise E.VectorInvalid(f"name {name!r}")
    return name


vector_id = collection_name


def dimensions(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= MAX_DIMENSIONS:
        raise E.VectorInvalid(f"dimensions {n!r}")
    return n


def metric(name: str) -> str:
    if name not in METRICS:
        raise E.VectorInvalid(f"metric {name!r}")
    return name


def values(v: Iterable[float], dims: int, metric_name: str) -> list[float]:
    out = [float(x) for x in v]
    if len(out) != dims:
        raise E.VectorDimensionMismatch(f"{len(out)} values, {dims} dimensions")
    if not all(map(math.isfinite, out)):
        raise E.VectorInvalid("a value is not finite")
    if metric_name == "cosine" and not any(out):
        raise E.VectorInvalid("a cosine vector has norm 0")
    return out


def max_distance(d: float) -> float:
    if isinstance(d, bool) or not isinstance(d, (int, float)) or not math.isfinite(d):
        raise E.VectorInvalid(f"max_distance {d!r}")
    return float(d)


def limit(n: int, error: type[Exception] = E.VectorInvalid) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or not 0 <= n <= MAX_I64:
        raise error(f"limit {n!r}")
    return n


def symbol(name: str, error: type[Exception] = E.GraphInvalid) -> str:
    if not isinstance(name, str) or not re.fullmatch(SYMBOL, name) or reserved(name):
        raise error(f"name {name!r}")
    return name


graph_name = edge_type = kind = symbol


def node_id(name: str) -> str:
    if not 1 <= len(_utf8(name, E.GraphInvalid)) <= 512 or "\0" in name or reserved(name):
        raise E.GraphInvalid(f"node id {name!r}")
    return name


def target(kind_: str, namespace: str | None, ref: str | None) -> None:
    if kind_ not in TARGET_TYPES:
        raise E.GraphInvalid(f"target type {kind_!r}")
    for x in (namespace, ref):
        if x is not None and (b"\0" in _utf8(x, E.GraphInvalid)):
            raise E.GraphInvalid("a target has a NUL")


def direction(name: str) -> str:
    if name not in DIRECTIONS:
        raise E.GraphInvalid(f"direction {name!r}")
    return name


def channel(name: str) -> str:
    return symbol(name, E.InvalidArgument)


def payload(text: str) -> str:
    if len(_utf8(text, E.InvalidArgument)) > 65_536:
        raise E.InvalidArgument("a payload has at most 64 KiB")
    return text


def savepoint(name: str) -> str:
    if not isinstance(name, str) or not IDENTIFIER.match(name) or reserved(name):
        raise E.InvalidArgument(f"savepoint {name!r}")
    return name
