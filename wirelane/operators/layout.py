"""Record layouts: how the bytes of a fixed-size record become typed columns.

A Layout is an ordered list of named fields. Its offsets are constants, so decoding is a set of
Catalyst expressions over the binary column: those that a query does not select are pruned, and
nothing is decoded for them. The same layout packs and unpacks bytes in Python, for kernels and tests.
"""

from __future__ import annotations

import dataclasses
import struct
import typing
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BIG, LITTLE = "big", "little"
#: Byte order given when a record is decoded.
RUNTIME = "runtime"


class LayoutError(ValueError):
    """A layout that has no meaning, or a field that it does not have."""


@dataclasses.dataclass(frozen=True)
class Field:
    """One field: kind is u, i, f, bool, ubits, ibits, raw, array or record; bits is its width on the wire."""

    kind: str
    bits: int
    order: str = BIG
    item: Any = None
    count: int = 0

    def data_type(self) -> T.DataType:
        if self.kind in ("u", "ubits"):
            n = -(-self.bits // 8)
            return T.ShortType() if n == 1 else T.IntegerType() if n == 2 else T.LongType() if n < 8 else T.DecimalType(20, 0)
        if self.kind in ("i", "ibits"):
            n = -(-self.bits // 8)
            return T.ByteType() if n == 1 else T.ShortType() if n == 2 else T.IntegerType() if n <= 4 else T.LongType()
        if self.kind == "f":
            return T.FloatType() if self.bits == 32 else T.DoubleType()
        if self.kind == "bool":
            return T.BooleanType()
        if self.kind == "raw":
            return T.BinaryType()
        if self.kind == "array":
            return T.ArrayType(self.item.data_type(), False)
        return self.item.schema()


def uint(bits: int, order: str = BIG) -> Field:
    if bits not in (8, 16, 24, 32, 40, 48, 56, 64):
        raise LayoutError("integers have 1 to 8 whole bytes")
    return Field("u", bits, order)


def sint(bits: int, order: str = BIG) -> Field:
    if bits not in (8, 16, 24, 32, 40, 48, 56, 64):
        raise LayoutError("integers have 1 to 8 whole bytes")
    return Field("i", bits, order)


def real(bits: int, order: str = BIG) -> Field:
    if bits not in (32, 64):
        raise LayoutError("floats have 32 or 64 bits")
    return Field("f", bits, order)


def ubits(bits: int, order: str = "msb0") -> Field:
    if not 1 <= bits <= 64:
        raise LayoutError("bit fields have 1 to 64 bits")
    return Field("ubits", bits, order)


def ibits(bits: int, order: str = "msb0") -> Field:
    if not 2 <= bits <= 64:
        raise LayoutError("signed bit fields have 2 to 64 bits")
    return Field("ibits", bits, order)


def boolean() -> Field:
    return Field("bool", 8)


def raw(count: int) -> Field:
    """A fixed number of bytes, kept as they are."""
    return Field("raw", 8 * count, count=count)


def array(item: Field | Layout, count: int) -> Field:
    item = item if isinstance(item, Field) else record(item)
    if item.kind in ("ubits", "ibits"):
        raise LayoutError("arrays have items of whole bytes")
    return Field("array", item.bits * count, item=item, count=count)


def record(layout: Layout) -> Field:
    return Field("record", 8 * layout.size, item=layout)


u8, i8 = uint(8), sint(8)
be_u16, be_u24, be_u32, be_u48, be_u64 = (uint(n) for n in (16, 24, 32, 48, 64))
le_u16, le_u24, le_u32, le_u48, le_u64 = (uint(n, LITTLE) for n in (16, 24, 32, 48, 64))
be_i16, be_i32, be_i64 = (sint(n) for n in (16, 32, 64))
le_i16, le_i32, le_i64 = (sint(n, LITTLE) for n in (16, 32, 64))
be_f32, be_f64, le_f32, le_f64 = real(32), real(64), real(32, LITTLE), real(64, LITTLE)


class Layout:
    """Named fields in wire order. A bit field starts where the one before ends; all others start on a byte, and so does the end."""

    def __init__(self, name: str, fields: list[tuple[str, Field | Layout]]):
        self.name = name
        self.fields = [(n, f if isinstance(f, Field) else record(f)) for n, f in fields]
        if len({n for n, _ in self.fields}) != len(self.fields):
            raise LayoutError(f"{name}: two fields of one name")
        at, self.offsets = 0, {}
        for n, f in self.fields:
            if f.kind not in ("ubits", "ibits") and at % 8:
                raise LayoutError(f"{name}.{n} does not start on a byte")
            self.offsets[n] = at
            at += f.bits
        if at % 8:
            raise LayoutError(f"{name} does not end on a byte")
        self.size = at // 8
        # How unpack() takes each field: a shift and a mask of the record as one integer, the place of raw bytes, or neither.
        plain = lambda f: f.kind == "u" and f.order == BIG or f.kind == "ubits" and f.order == "msb0"
        self._plan = [(n, f, at - self.offsets[n] - f.bits, (1 << f.bits) - 1) if plain(f) else (n, f, self.offsets[n] // 8, 0) for n, f in self.fields]

    @classmethod
    def of(cls, described: type) -> Layout:
        """The layout of a class whose annotations are fields or other such classes."""
        hints = typing.get_type_hints(described, include_extras=True)
        fields = []
        for n, hint in hints.items():
            found = [m for m in getattr(hint, "__metadata__", ()) if isinstance(m, (Field, Layout))]
            if not found and hasattr(hint, "__annotations__"):
                found = [cls.of(hint)]
            if not found:
                raise LayoutError(f"{described.__name__}.{n} has no field")
            fields.append((n, found[0]))
        return cls(described.__name__, fields)

    def __getitem__(self, name: str) -> Field:
        for n, f in self.fields:
            if n == name:
                return f
        raise LayoutError(f"{self.name} has no field {name}")

    def schema(self) -> T.StructType:
        """Non-null columns; raw fields tell their size in their metadata."""
        return T.StructType([T.StructField(n, f.data_type(), False, {"fixed_size": f.count} if f.kind == "raw" else {}) for n, f in self.fields])

    def leaves(self, prefix: str = "") -> Iterator[tuple[str, Field]]:
        """Fields below records, under dotted names, in wire order."""
        for n, f in self.fields:
            if f.kind == "record":
                yield from f.item.leaves(f"{prefix}{n}.")
            else:
                yield prefix + n, f

    def leaf_columns(self) -> list[str]:
        return [n for n, _ in self.leaves()]

    # Catalyst

    def fits(self, buf: Column, pos: Column | int = 0, end: Column | None = None) -> Column:
        pos = F.lit(pos) if isinstance(pos, int) else pos
        return (pos >= 0) & (pos + F.lit(self.size) <= (F.octet_length(buf) if end is None else end))

    def view(self, buf: Column, pos: Column | int = 0, order: str | Column = BIG) -> View:
        """Columns decoded where they are used; null where the record does not fit."""
        return View(self, buf, F.lit(pos) if isinstance(pos, int) else pos, order)

    def decode(self, buf: Column, pos: Column | int = 0, order: str | Column = BIG) -> Column:
        """The whole record as a struct; null where it does not fit in the buffer."""
        view = self.view(buf, pos, order)
        # An element of a list, not a branch of a condition: within branches Spark would make each cell again for each field.
        return F.element_at(F.array(view.struct(), F.lit(None)), F.when(view.bytes.isNotNull(), 1).otherwise(2))

    def encode(self, values: dict[str, Column]) -> Column:
        """The record's bytes from columns: integers, bit fields, bools, raw bytes and records. Values are taken modulo their width.

        Neighbouring integers are put together in words of up to 8 bytes, so a word costs one conversion.
        """
        parts: list[Column] = []
        words: list[tuple[int, Column]] = []
        self._gather(values, parts, words)
        _flush(parts, words)
        return F.concat(*parts) if len(parts) != 1 else parts[0]

    def _gather(self, values: Any, parts: list[Column], words: list[tuple[int, Column]]) -> None:
        bits: list[tuple[Field, Column]] = []

        def close() -> None:
            if not bits:
                return
            orders = {f.order for f, _ in bits}
            width = sum(f.bits for f, _ in bits)
            if len(orders) > 1 or width > 56 or width % 8:
                raise LayoutError("a run of bit fields to encode has one order and whole bytes, 7 at most")
            total, at = None, 0
            for f, value in bits:
                part = F.shiftleft(_low(value, f.bits), width - at - f.bits if f.order == "msb0" else at)
                total = part if total is None else total.bitwiseOR(part)
                at += f.bits
            words.append((width, total if orders == {"msb0"} else _swap(total, width // 8)))
            bits.clear()

        for n, f in self.fields:
            value = values[n]
            if f.kind in ("ubits", "ibits"):
                bits.append((f, value))
                continue
            close()
            if f.kind in ("u", "i", "bool"):
                words.append((f.bits, _ordered(value, f)))
            elif f.kind == "raw":
                _flush(parts, words)
                parts.append(value)
            elif f.kind == "record":
                f.item._gather({m: value[m] for m, _ in f.item.fields}, parts, words)
            elif f.kind == "array" and f.item.kind in ("u", "i"):
                words.extend((f.item.bits, _ordered(F.element_at(value, k + 1), f.item)) for k in range(f.count))
            else:
                raise LayoutError(f"{n}: bit patterns of {f.kind} are made by pack()")
        close()

    # Python

    def unpack(self, data: bytes, pos: int = 0, order: str = BIG) -> dict[str, Any]:
        if pos + self.size > len(data):
            raise LayoutError(f"{self.name} needs {self.size} bytes")
        whole = int.from_bytes(data[pos : pos + self.size], BIG)
        out = {}
        for n, f, shift, mask in self._plan:
            out[n] = (whole >> shift) & mask if mask else bytes(data[pos + shift : pos + shift + f.count]) if f.kind == "raw" else _unpack(f, data, 8 * pos + self.offsets[n], order)
        return out

    def arrays(self, rows: np.ndarray) -> list[pa.Array]:
        """Columns of many records at once, each a row of bytes of a matrix; fields of a fixed byte order."""
        return [_arrow(f, rows, self.offsets[n]) for n, f in self.fields]

    def table(self, rows: np.ndarray) -> pa.StructArray:
        return pa.StructArray.from_arrays(self.arrays(rows), [n for n, _ in self.fields])

    def pack(self, values: dict[str, Any], order: str = BIG) -> bytes:
        out = bytearray(self.size)
        for n, f in self.fields:
            _pack(f, out, self.offsets[n], values[n], order)
        return bytes(out)


def _low(value: Column, bits: int) -> Column:
    """The low bits of an integer."""
    return value.cast("long") if bits == 64 else value.cast("long").bitwiseAND(F.lit((1 << bits) - 1))


def _swap(value: Column, n: int) -> Column:
    """The low n bytes of a long in the other order."""
    byte = lambda k: F.shiftrightunsigned(value, 8 * k).bitwiseAND(F.lit(255))
    return reduce(Column.bitwiseOR, (F.shiftleft(byte(k), 8 * (n - 1 - k)) for k in range(n))) if n > 1 else value


def _ordered(value: Column, f: Field) -> Column:
    low = _low(value, f.bits)
    return _swap(low, f.bits // 8) if f.order == LITTLE else low


def _flush(parts: list[Column], words: list[tuple[int, Column]]) -> None:
    """The words gathered as one column of bytes, as many as fit in 8 bytes at a time."""
    digits: list[Column] = []
    while words:
        width, total = words.pop(0)
        while words and width + words[0][0] <= 64:
            more, value = words.pop(0)
            width, total = width + more, F.shiftleft(total, more).bitwiseOR(value)
        digits.append(F.lpad(F.hex(total), width // 4, "0"))
    if digits:
        parts.append(F.unhex(F.concat(*digits) if len(digits) > 1 else digits[0]))


class View:
    """A record at a place of a binary column; nothing is decoded but what is asked for.

    Bytes become numbers 8 at a time: fields that share such a cell share its conversion.
    """

    def __init__(self, layout: Layout, buf: Column, pos: Column, order: str | Column):
        self.layout, self.buf, self.pos, self.order = layout, buf, pos, order
        # Null where the record does not fit, and so is all that is made of it: no field needs a test of its own.
        self.bytes = F.when(layout.fits(buf, pos), F.substring(buf, pos + 1, F.lit(layout.size)))

    def __getitem__(self, name: str) -> Column:
        """The field of that name, dotted below records; an unknown name is an error at once."""
        at, layout = 0, self.layout
        *above, last = name.split(".")
        for n in above:
            at += layout.offsets[n] if layout[n].kind == "record" else 0
            layout = layout[n].item
        f = layout[last]
        found = self._column(f, at + layout.offsets[last])
        return F.when(self.bytes.isNotNull(), found) if f.kind in ("record", "array") else found

    def raw(self) -> Column:
        return self.bytes

    def struct(self) -> Column:
        return F.struct(*(self._column(f, self.layout.offsets[n]).alias(n) for n, f in self.layout.fields))

    def flat(self) -> list[Column]:
        return [self[n].alias(n) for n in self.layout.leaf_columns()]

    def _word(self, at: int, n: int) -> Column:
        """The n bytes from a place, most significant first, as the bits of a long."""
        first = at // 8 * 8
        size = min(8, self.layout.size - first)
        if at + n > first + size:
            first, size = at, n
        cell = F.conv(F.hex(F.substring(self.bytes, first + 1, size)), 16, -10).cast("long")
        shift = 8 * (first + size - at - n)
        part = F.shiftrightunsigned(cell, shift) if shift else cell
        return part if n == size else part.bitwiseAND(F.lit((1 << 8 * n) - 1))

    def _int(self, at: int, n: int, order: str) -> Column:
        forward = self._word(at, n)
        if n == 1 or order == BIG:
            return forward
        backward = _swap(forward, n)
        if order == LITTLE:
            return backward
        if isinstance(self.order, str):
            return forward if self.order == BIG else backward
        return F.when(self.order == BIG, forward).otherwise(backward)

    def _column(self, f: Field, bit: int) -> Column:
        kind = f.data_type()
        if f.kind == "raw":
            return F.substring(self.bytes, bit // 8 + 1, f.count)
        if f.kind == "record":
            return F.struct(*(self._column(g, bit + f.item.offsets[n]).alias(n) for n, g in f.item.fields))
        if f.kind == "array":
            return F.array(*(self._column(f.item, bit + k * f.item.bits) for k in range(f.count))) if f.count else F.expr(f"cast(array() as {kind.simpleString()})")
        if f.kind in ("ubits", "ibits"):
            return _signed(self._bits(f, bit), f.bits, kind) if f.kind == "ibits" else self._bits(f, bit).cast(kind)
        x = self._int(bit // 8, f.bits // 8, f.order)
        if f.kind == "u":
            return _unsigned(x) if f.bits == 64 else x.cast(kind)
        if f.kind == "bool":
            return x != 0
        return _signed(x, f.bits, kind) if f.kind == "i" else _real(x, f.bits)

    def _bits(self, f: Field, bit: int) -> Column:
        first, last = bit // 8, (bit + f.bits - 1) // 8
        n = last - first + 1
        big = f.order == "msb0"
        shift = 8 * n - (bit - 8 * first) - f.bits if big else bit - 8 * first
        if n > 8:  # 9 bytes: the low 64 bits after the shift lie in two parts
            high, low = (self._word(first, 1), self._word(first + 1, 8)) if big else (self._word(last, 1), _swap(self._word(first, 8), 8))
            value = F.shiftrightunsigned(low, shift).bitwiseOR(F.shiftleft(high, 64 - shift))
        else:
            value = F.shiftrightunsigned(self._int(first, n, BIG if big else LITTLE), shift)
        if f.bits < 64:
            return value.bitwiseAND(F.lit((1 << f.bits) - 1))
        return value if f.kind == "ibits" else _unsigned(value)


def _unsigned(x: Column) -> Column:
    """A long's bits as an unsigned number."""
    return (x.cast("decimal(20,0)") + F.when(x < 0, F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))).cast("decimal(20,0)")


def _signed(value: Column, bits: int, kind: T.DataType) -> Column:
    if bits == 64:
        return value.cast("long")
    return (value - F.when(value >= F.lit(1 << (bits - 1)), F.lit(1 << bits)).otherwise(F.lit(0).cast("long"))).cast(kind)


def _real(x: Column, bits: int) -> Column:
    """IEEE 754 from its bits: sums and products of powers of two are exact."""
    mantissa, bias = (23, 127) if bits == 32 else (52, 1023)
    exponent = F.shiftrightunsigned(x, mantissa).bitwiseAND(F.lit((1 << (bits - 1 - mantissa)) - 1))
    part = x.bitwiseAND(F.lit((1 << mantissa) - 1))
    whole = F.when(exponent == 0, part).otherwise(part + F.lit(1 << mantissa)).cast("double")
    size = whole * F.pow(F.lit(2.0), (F.greatest(exponent, F.lit(1).cast("long")) - F.lit(bias + mantissa)).cast("double"))
    top = F.lit((1 << (bits - 1 - mantissa)) - 1)
    size = F.when(exponent == top, F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(size)
    value = F.when(F.shiftrightunsigned(x, bits - 1).bitwiseAND(F.lit(1)) == 1, -size).otherwise(size)
    return value.cast("float") if bits == 32 else value


def _unpack(f: Field, data: bytes, bit: int, order: str) -> Any:
    at, n = bit // 8, f.bits // 8
    own = (BIG if f.kind == "bool" else order) if f.order == RUNTIME else f.order
    if f.kind == "u":
        return int.from_bytes(data[at : at + n], own)
    if f.kind == "i":
        return int.from_bytes(data[at : at + n], own, signed=True)
    if f.kind == "bool":
        return data[at] != 0
    if f.kind == "f":
        return struct.unpack((">" if own == BIG else "<") + ("f" if f.bits == 32 else "d"), data[at : at + n])[0]
    if f.kind == "raw":
        return bytes(data[at : at + n])
    if f.kind == "record":
        return f.item.unpack(data, at, order)
    if f.kind == "array":
        return [_unpack(f.item, data, bit + k * f.item.bits, order) for k in range(f.count)]
    last = (bit + f.bits - 1) // 8
    whole = int.from_bytes(data[at : last + 1], BIG if f.order == "msb0" else LITTLE)
    value = whole >> (8 * (last + 1) - bit - f.bits if f.order == "msb0" else bit - 8 * at) & ((1 << f.bits) - 1)
    return value - (1 << f.bits) if f.kind == "ibits" and value >> (f.bits - 1) else value


#: Integers of a column's type in numpy, by the bytes of its Spark type.
_NUMPY = {T.ByteType: np.int8, T.ShortType: np.int16, T.IntegerType: np.int32, T.LongType: np.int64}


def _numbers(f: Field, rows: np.ndarray, bit: int) -> np.ndarray:
    """The unsigned bits of an integer or bit field of up to 8 bytes in each row."""
    first, last = bit // 8, (bit + f.bits - 1) // 8
    little = f.order in (LITTLE, "lsb0")
    out = np.zeros(len(rows), np.uint64)
    for k in range(last, first - 1, -1) if little else range(first, last + 1):
        out = (out << np.uint64(8)) | rows[:, k]
    if f.kind in ("ubits", "ibits"):
        out = (out >> np.uint64(bit - 8 * first if little else 8 * (last + 1) - bit - f.bits)) & np.uint64((1 << f.bits) - 1)
    return out


def bytes_array(rows: np.ndarray) -> pa.BinaryArray:
    """Each row of a matrix of bytes as one value."""
    n, size = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(size)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _arrow(f: Field, rows: np.ndarray, bit: int) -> pa.Array:
    at = bit // 8
    if f.kind == "raw":
        return bytes_array(rows[:, at : at + f.count])
    if f.kind == "record":
        return pa.StructArray.from_arrays([_arrow(g, rows, bit + f.item.offsets[n]) for n, g in f.item.fields], [n for n, _ in f.item.fields])
    if f.order == RUNTIME or f.bits > 64 or f.kind == "array" or (bit + f.bits - 1) // 8 - at > 7:
        return pa.array([_unpack(f, bytes(r), bit, BIG) for r in rows], to_arrow_type(f.data_type()))
    if f.kind == "f":
        return pa.array(np.ascontiguousarray(rows[:, at : at + f.bits // 8]).view((">" if f.order == BIG else "<") + f"f{f.bits // 8}").ravel().astype(f"f{f.bits // 8}"))
    x = _numbers(f, rows, bit)
    if f.kind == "bool":
        return pa.array(x != 0)
    kind = f.data_type()
    if isinstance(kind, T.DecimalType):
        return pa.array(x).cast(pa.decimal128(20, 0))
    if f.kind in ("i", "ibits"):
        x = ((x << np.uint64(64 - f.bits)).view(np.int64)) >> np.int64(64 - f.bits)
    return pa.array(x.astype(_NUMPY[type(kind)]))


def _pack(f: Field, out: bytearray, bit: int, value: Any, order: str) -> None:
    at, n = bit // 8, f.bits // 8
    own = order if f.order == RUNTIME else f.order
    if f.kind in ("u", "i"):
        out[at : at + n] = (value & ((1 << f.bits) - 1)).to_bytes(n, own)
    elif f.kind == "bool":
        out[at] = int(value)
    elif f.kind == "f":
        out[at : at + n] = struct.pack((">" if own == BIG else "<") + ("f" if f.bits == 32 else "d"), value)
    elif f.kind == "raw":
        if len(value) != f.count:
            raise LayoutError(f"{f.count} bytes are wanted")
        out[at : at + n] = value
    elif f.kind == "record":
        out[at : at + n] = f.item.pack(value, order)
    elif f.kind == "array":
        for k, x in enumerate(value):
            _pack(f.item, out, bit + k * f.item.bits, x, order)
    else:
        last = (bit + f.bits - 1) // 8
        side = BIG if f.order == "msb0" else LITTLE
        shift = 8 * (last + 1) - bit - f.bits if f.order == "msb0" else bit - 8 * at
        mask = ((1 << f.bits) - 1) << shift
        whole = int.from_bytes(out[at : last + 1], side) & ~mask | (value << shift) & mask
        out[at : last + 1] = whole.to_bytes(last + 1 - at, side)
