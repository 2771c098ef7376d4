import math
import random
from typing import Annotated

import pytest
from pyspark.sql import functions as F

from wirelane.functions import schemas
from wirelane.operators import layout as ly
from wirelane.operators.layout import Layout, LayoutError, array, ibits, raw, record, ubits, uint

INNER = Layout("Inner", [("a", ubits(3)), ("b", ubits(13)), ("c", ly.le_u16)])
ALL = Layout("All", [
    ("x", ly.u8), ("y", ly.be_u24), ("z", ly.le_u48), ("w", ly.be_u64), ("s", ly.le_i32), ("t", ly.be_i64), ("f", ly.be_f32), ("d", ly.le_f64), ("bb", ly.boolean()),
    ("m", ubits(4, "lsb0")), ("n", ibits(12, "lsb0")), ("big", ubits(61)), ("sm", ibits(3)), ("r", raw(3)), ("ar", array(ly.le_u16, 2)), ("in", record(INNER)), ("i8", ly.i8),
])


def plain(x):
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, list):
        return [plain(v) for v in x]
    return bytes(x) if isinstance(x, bytearray) else int(x) if hasattr(x, "as_tuple") else x


def same(a, b):
    if isinstance(a, dict):
        return all(same(a[k], b[k]) for k in a)
    return a == b or isinstance(a, float) and math.isnan(a) and math.isnan(b)


def test_decode_agrees_with_unpack(spark):
    rng = random.Random(1)
    rows = [(bytes(rng.randrange(256) for _ in range(ALL.size + rng.randrange(-2, 4))),) for _ in range(200)]
    rows += [(bytes(ALL.size),), (b"\xff" * ALL.size,), (b"",), (None,)]
    for r in spark.createDataFrame(rows, "b binary").select("b", ALL.decode(F.col("b")).alias("r")).collect():
        if r.b is None or len(r.b) < ALL.size:
            assert r.r is None
        else:
            assert same(ALL.unpack(bytes(r.b)), plain(r.r))


def test_round_trip():
    rng = random.Random(2)
    for _ in range(50):
        data = bytearray(rng.randrange(256) for _ in range(ALL.size))
        data[42] &= 1  # a bool has two values
        values = ALL.unpack(bytes(data))
        if not any(isinstance(v, float) and math.isnan(v) for v in values.values()):
            assert ALL.pack(values) == bytes(data)


def test_encode_and_runtime_order(spark):
    order = Layout("O", [("v", uint(16, ly.RUNTIME))])
    df = spark.createDataFrame([(b"\x01\x02", "big"), (b"\x01\x02", "little")], "b binary, o string")
    assert [r[0] for r in df.select(order.view(F.col("b"), 0, F.col("o"))["v"]).collect()] == [258, 513]
    one = spark.range(1).select(INNER.encode({"a": F.lit(5), "b": F.lit(77), "c": F.lit(513)}).alias("b")).first().b
    assert INNER.unpack(bytes(one)) == {"a": 5, "b": 77, "c": 513}


def test_pruning(spark):
    df = spark.createDataFrame([(b"\0" * ALL.size,)], "b binary").select(ALL.view(F.col("b")).struct().alias("r")).select("r.x")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") == 1


def test_bad_layouts():
    with pytest.raises(LayoutError):
        Layout("x", [("a", ubits(3)), ("b", ly.u8)])
    with pytest.raises(LayoutError):
        Layout("x", [("a", ubits(3))])
    with pytest.raises(LayoutError):
        Layout("x", [("a", ly.u8), ("a", ly.u8)])
    with pytest.raises(LayoutError):
        ALL["nothing"]
    with pytest.raises(LayoutError):
        ubits(65)
    with pytest.raises(LayoutError):
        ALL.unpack(b"")


def test_annotations():
    class Point:
        x: Annotated[int, ly.be_u16]
        y: Annotated[int, ly.le_u16]

    class Line:
        a: Point
        b: Point

    assert Layout.of(Line).leaf_columns() == ["a.x", "a.y", "b.x", "b.y"]
    assert Layout.of(Line).unpack(b"\0\1\2\0\0\3\4\0") == {"a": {"x": 1, "y": 2}, "b": {"x": 3, "y": 4}}


def test_schemas():
    assert schemas.arrow_formats(INNER) == [("a", "C"), ("b", "S"), ("c", "S")]
    assert dict(schemas.arrow_formats(ALL))["ar"] == "+w:2" and dict(schemas.arrow_formats(ALL))["r"] == "w:3"
    assert schemas.csv_header(Layout("o", [("p", record(INNER)), ("q", raw(2))])) == "p.a,p.b,p.c,q"
    outer = Layout("o", [("p", record(INNER)), ("q", raw(2)), ("z", array(ly.u8, 2)), ("f", ly.be_f64)])
    values = {"p": {"a": 1, "b": 2, "c": 3}, "q": b"\xab\x01", "z": [1, 2], "f": 0.1}
    assert schemas.to_json(outer, values) == '{"p":{"a":1,"b":2,"c":3},"q":"ab01","z":[1,2],"f":0.1}'
    assert schemas.csv_row(outer, values) == '1,2,3,"ab01","[1,2]",0.1'
    import json

    schema = json.loads(schemas.avro_schema(outer))
    back, end = schemas.read_avro(schema, schemas.avro_row(outer, values))
    assert back == values and end == len(schemas.avro_row(outer, values))


def test_varints_and_floats():
    for n, data in ((0, b"\0"), (-1, b"\1"), (1, b"\2"), (63, b"\x7e"), (64, b"\x80\x01"), (-(2**63), b"\xff" * 9 + b"\1")):
        assert schemas.varint(n) == data and schemas.read_varint(data, 0) == (n, len(data))
    assert [schemas.shortest(x) for x in (0.1, 1.0, 1e300, -2.5)] == ["0.1", "1", "1e+300", "-2.5"]
    assert schemas.shortest(0.1, 32) == "0.1"
