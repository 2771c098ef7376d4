"""What a layout looks like elsewhere: Arrow format strings, Avro schemas, JSON and CSV rows, Avro values."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelane.operators.layout import Field, Layout

#: Arrow's codes of fixed-width types, by bytes.
_ARROW_UNSIGNED, _ARROW_SIGNED = {1: "C", 2: "S", 4: "I", 8: "L"}, {1: "c", 2: "s", 4: "i", 8: "l"}


def _width(f: Field) -> int:
    """The bytes of the integer that holds the field once decoded."""
    n = -(-f.bits // 8)
    return next(w for w in (1, 2, 4, 8) if n <= w)


def arrow_format(f: Field | Layout) -> str:
    """The format string of Arrow's C data interface for a field's decoded type."""
    if isinstance(f, Layout) or f.kind == "record":
        return "+s"
    if f.kind in ("u", "ubits", "bool"):
        return _ARROW_UNSIGNED[_width(f)]
    if f.kind in ("i", "ibits"):
        return _ARROW_SIGNED[_width(f)]
    if f.kind == "f":
        return "f" if f.bits == 32 else "g"
    return f"w:{f.count}" if f.kind == "raw" else f"+w:{f.count}"


def arrow_formats(layout: Layout) -> list[tuple[str, str]]:
    """(dotted name, format) of the leaves."""
    return [(n, arrow_format(f)) for n, f in layout.leaves()]


def _avro_type(f: Field, name: str, path: str) -> Any:
    if f.kind in ("u", "ubits", "bool"):
        return "int" if _width(f) < 4 else "long"
    if f.kind in ("i", "ibits"):
        return "int" if _width(f) < 8 else "long"
    if f.kind == "f":
        return "float" if f.bits == 32 else "double"
    if f.kind == "raw":
        return {"type": "fixed", "name": f"{path}_fx", "size": f.count}
    if f.kind == "array":
        return {"type": "array", "items": _avro_type(f.item, name, path)}
    return _avro_record(f.item, path)


def _avro_record(layout: Layout, path: str) -> dict:
    # Type names hold the path, so that each is defined once however often a layout occurs.
    return {"type": "record", "name": path, "fields": [{"name": n, "type": _avro_type(f, n, f"{path}_{n}")} for n, f in layout.fields]}


def avro_schema(layout: Layout) -> str:
    """The Avro schema of the record, as compact JSON."""
    return json.dumps(_avro_record(layout, re.sub(r"\W+", "_", layout.name)), separators=(",", ":"))


def to_json(layout: Layout, values: dict[str, Any]) -> str:
    """Compact JSON in the order of the fields: raw bytes as hex, bools as 0 and 1, floats in their shortest form."""
    return "{" + ",".join(f'"{n}":{_json(f, values[n])}' for n, f in layout.fields) + "}"


def shortest(x: float, bits: int = 64) -> str:
    """The shortest decimal that reads back as the same float of so many bits."""
    import numpy as np

    value = np.float32(x) if bits == 32 else np.float64(x)
    if not np.isfinite(value):
        return "nan" if np.isnan(value) else "inf" if value > 0 else "-inf"
    plain = np.format_float_positional(value, trim="-")
    power = re.sub(r"e([+-])(\d)$", r"e\g<1>0\2", np.format_float_scientific(value, trim="-"))
    return power if len(power) < len(plain) else plain


def _json(f: Field, value: Any) -> str:
    if f.kind == "raw":
        return f'"{value.hex()}"'
    if f.kind == "record":
        return to_json(f.item, value)
    if f.kind == "array":
        return "[" + ",".join(_json(f.item, v) for v in value) + "]"
    return shortest(value, f.bits) if f.kind == "f" else str(int(value))


def csv_header(layout: Layout) -> str:
    return ",".join(layout.leaf_columns())


def csv_row(layout: Layout, values: dict[str, Any]) -> str:
    """The leaves of a record, comma-joined; raw bytes are quoted hex, lists quoted."""
    cells = []
    for name, f in layout.leaves():
        value: Any = values
        for part in name.split("."):
            value = value[part]
        cell = _json(f, value)
        cells.append(f'"{cell}"' if f.kind == "array" else cell)
    return ",".join(cells)


def json_expression(layout: Layout, record: Column) -> Column:
    """to_json() of a decoded struct column, as a Catalyst expression; layouts without floats."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), _json_column(f, record[n])) for n, f in layout.fields)), F.lit("}"))


def _json_column(f: Field, c: Column) -> Column:
    if f.kind == "raw":
        return F.concat(F.lit('"'), F.lower(F.hex(c)), F.lit('"'))
    if f.kind == "record":
        return json_expression(f.item, c)
    if f.kind == "array":
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _json_column(f.item, x)), ","), F.lit("]"))
    if f.kind == "f":
        raise ValueError("floats have their shortest form in to_json() alone")
    return c.cast("int").cast("string") if f.kind == "bool" else c.cast("string")


# Avro values


def varint(n: int) -> bytes:
    """A signed integer, zigzag and base 128."""
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            return (n >> 1) ^ -(n & 1), at


def avro_bytes(data: bytes) -> bytes:
    return varint(len(data)) + data


def avro_row(layout: Layout, values: dict[str, Any]) -> bytes:
    """A record's binary encoding, depth first. Unsigned 64-bit values wrap to signed ones."""
    return b"".join(_avro_value(f, values[n]) for n, f in layout.fields)


def _avro_value(f: Field, value: Any) -> bytes:
    if f.kind in ("u", "i", "ubits", "ibits", "bool"):
        n = int(value)
        return varint(n - (1 << 64) if n >= 1 << 63 else n)
    if f.kind == "f":
        return struct.pack("<f" if f.bits == 32 else "<d", value)
    if f.kind == "raw":
        return bytes(value)
    if f.kind == "record":
        return avro_row(f.item, value)
    items = b"".join(_avro_value(f.item, v) for v in value)
    return (varint(f.count) + items if f.count else b"") + b"\0"


def read_avro(schema: Any, data: bytes, at: int = 0) -> tuple[Any, int]:
    """A value of an Avro schema (parsed JSON) and the place after it: a reader of its own, for any schema of these kinds."""
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(schema, list):
        branch, at = read_varint(data, at)
        return read_avro(schema[branch], data, at)
    if kind == "null":
        return None, at
    if kind == "boolean":
        return data[at] != 0, at + 1
    if kind in ("int", "long"):
        return read_varint(data, at)
    if kind in ("float", "double"):
        n = 4 if kind == "float" else 8
        return struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0], at + n
    if kind in ("bytes", "string"):
        n, at = read_varint(data, at)
        raw = data[at : at + n]
        return raw.decode() if kind == "string" else raw, at + n
    if kind == "fixed":
        return data[at : at + schema["size"]], at + schema["size"]
    if kind == "array":
        out = []
        while True:
            n, at = read_varint(data, at)
            if n < 0:
                n = -n
                _, at = read_varint(data, at)
            if not n:
                return out, at
            for _ in range(n):
                value, at = read_avro(schema["items"], data, at)
                out.append(value)
    if kind == "record":
        record = {}
        for field in schema["fields"]:
            record[field["name"]], at = read_avro(field["type"], data, at)
        return record, at
    raise ValueError(f"no reader for {kind}")


MAGIC = b"Obj\x01"


def ocf_header(schema: str, sync: bytes) -> bytes:
    meta = {"avro.schema": schema.encode(), "avro.codec": b"null"}
    pairs = b"".join(avro_bytes(k.encode()) + avro_bytes(v) for k, v in meta.items())
    return MAGIC + varint(len(meta)) + pairs + b"\0" + sync


def ocf_block(rows: list[bytes], sync: bytes) -> bytes:
    data = b"".join(rows)
    return varint(len(rows)) + varint(len(data)) + data + sync


def _ocf_meta(data: bytes) -> tuple[dict[str, bytes], int]:
    """The metadata of a container's header and the place after it; IndexError if the header is not whole."""
    if data[:4] != MAGIC:
        raise ValueError("no Avro object container")
    meta, at = {}, 4
    while True:
        n, at = read_varint(data, at)
        if n < 0:
            _, at = read_varint(data, at)
        if not n:
            break
        for _ in range(abs(n)):
            key, at = read_avro("string", data, at)
            meta[key], at = read_avro("bytes", data, at)
    if at + 16 > len(data):
        raise IndexError("the header is not whole")
    return meta, at


def ocf_schema(data: bytes) -> Any:
    """The schema in a container's header, parsed."""
    return json.loads(_ocf_meta(data)[0]["avro.schema"])


def read_ocf(data: bytes) -> Iterator[Any]:
    """The records of an Avro object container file with the codec `null`."""
    meta, at = _ocf_meta(data)
    if meta.get("avro.codec", b"null") != b"null":
        raise ValueError("only the codec null is read")
    schema, sync = json.loads(meta["avro.schema"]), data[at : at + 16]
    at += 16
    while at < len(data):
        n, at = read_varint(data, at)
        _, at = read_varint(data, at)
        for _ in range(n):
            record, at = read_avro(schema, data, at)
            yield record
        if data[at : at + 16] != sync:
            raise ValueError("a block does not end with the file's marker")
        at += 16
