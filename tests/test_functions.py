import random
import struct

import pytest

from stratalode import errors as E
from stratalode import validate
from stratalode.functions import fastcdc, scalars


def stepwise(data):
    """Boundaries by the definition, a byte at a time."""
    out, start = [], 0
    while start < len(data):
        n = len(data) - start
        end = min(n, fastcdc.MAX)
        fp = 0
        if n > fastcdc.MIN:
            for i in range(fastcdc.MIN, end):
                fp = ((fp << 1) + fastcdc.GEAR[data[start + i]]) & fastcdc.BITS
                if not fp & (fastcdc.MASK_SHORT if i < fastcdc.AVERAGE else fastcdc.MASK_LONG):
                    end = i + 1
                    break
        out.append((start, end))
        start += end
    return out


def test_golden_boundaries():
    data = bytes((3 * i + i // 6 + 6) % 256 for i in range(160 * 1024))
    assert [n for _, n in fastcdc.boundaries(data)] == [9685, *[9216] * 16, 6699]


@pytest.mark.parametrize("size", [0, 1, 2047, 2048, 2049, 2100, 8191, 8192, 8193, 65535, 65536, 65537, 150_000])
def test_boundaries_by_definition(size):
    for data in (random.Random(size).randbytes(size), bytes(size), b"ab" * (size // 2)):
        assert fastcdc.boundaries(data) == stepwise(data)


def test_stream_has_the_same_boundaries():
    rng = random.Random(4)
    data = rng.randbytes(300_000)
    chunker, out, at = fastcdc.StreamChunker(), [], 0
    while at < len(data):
        n = rng.choice([1, 100, 5_000, 70_000])
        out += chunker.write(data[at : at + n])
        assert len(chunker.held) <= fastcdc.MAX
        at += n
    out += chunker.finish()
    assert b"".join(out) == data
    assert [len(c) for c in out] == [n for _, n in fastcdc.boundaries(data)]


def test_codecs():
    assert scalars.encode_f32_le([1.0, -2.5]) == struct.pack("<2f", 1.0, -2.5)
    assert scalars.decode_f32_le(scalars.encode_f32_le([1.0, -2.5]), 2) == [1.0, -2.5]
    with pytest.raises(E.VectorCorrupt):
        scalars.decode_f32_le(b"1234", 2)
    with pytest.raises(E.VectorCorrupt):
        scalars.decode_f32_le(struct.pack("<f", float("nan")), 1)
    assert scalars.parse_hex_id("Aa" * 32) == b"\xaa" * 32
    with pytest.raises(E.InvalidArgument):
        scalars.parse_hex_id("aa")


def test_codecs_of_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [])], "i int, v array<float>")
    got = rows.select("i", scalars.encode_f32("v").alias("b")).select("i", "b", scalars.decode_f32("b").alias("v")).orderBy("i").collect()
    assert [bytes(r.b) if r.b is not None else None for r in got] == [struct.pack("<2f", 1, 2), None, b""]
    assert [r.v for r in got] == [[1.0, 2.0], None, []]


@pytest.mark.parametrize(
    ("check", "value", "error"),
    [
        (validate.collection_name, "", E.VectorInvalid),
        (validate.collection_name, "é" * 128, E.VectorInvalid),
        (validate.collection_name, "_StrataLode_x", E.VectorInvalid),
        (validate.dimensions, 0, E.VectorInvalid),
        (validate.dimensions, 16_385, E.VectorInvalid),
        (validate.dimensions, True, E.VectorInvalid),
        (validate.metric, "l1", E.VectorInvalid),
        (validate.max_distance, float("inf"), E.VectorInvalid),
        (validate.graph_name, "a b", E.GraphInvalid),
        (validate.graph_name, "a" * 129, E.GraphInvalid),
        (validate.graph_name, "a\n", E.GraphInvalid),
        (validate.node_id, "a\0b", E.GraphInvalid),
        (validate.node_id, "x" * 513, E.GraphInvalid),
        (validate.direction, "both", E.GraphInvalid),
        (validate.channel, "", E.InvalidArgument),
        (validate.payload, "x" * 65_537, E.InvalidArgument),
        (validate.savepoint, "1a", E.InvalidArgument),
        (validate.savepoint, "a" * 65, E.InvalidArgument),
    ],
)
def test_rules(check, value, error):
    with pytest.raises(error):
        check(value)


def test_rules_accept():
    assert validate.collection_name("é" * 127) == "é" * 127
    assert validate.node_id("message:1 é") == "message:1 é"
    assert validate.symbol("a.b:c-d_9") == "a.b:c-d_9"
    assert validate.values([0.0, 1.0], 2, "cosine") == [0.0, 1.0]
    with pytest.raises(E.VectorInvalid):
        validate.values([0.0, 0.0], 2, "cosine")
    with pytest.raises(E.VectorDimensionMismatch):
        validate.values([0.0], 2, "l2")
